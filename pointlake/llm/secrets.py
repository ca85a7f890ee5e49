"""Secret scans: patterns for known kinds, probabilistic automata for formats like them.

Base spans are regular expressions per kind. Beyond them, the formats of credentials are
learned from labelled ones: values that the base patterns label in the corpus, with their
kind, and made-up values of FORMATS, public formats given by their parts, one kind each
(more can be given to ``fit``). Of each kind two probabilistic automata are inferred (see
``automaton``): one of whole values, which keeps constant prefixes and lengths, and one
of their second halves without their ends, a loop over the kind's alphabet that also
knows formats of which no value was seen. Others are inferred from ordinary words and
from what is commonly made of them: identifiers, paths, dates, numbers, borders, UUIDs.
Every candidate, a run of credential characters not mostly covered by base spans, is
scored by its log likelihood under the best automaton of credentials, less the logarithm
of their number, against the best ordinary one, and becomes a span of kind ``format`` if
it reaches the model's ``least``. An ordinary run gets there with a chance of at most
FALSE, as likelihood ratios do; ``least`` is raised to what ordinary values held back
from the fit reach.

Training values are a bounded sample, SAMPLE different values a kind (ORDINARY_SAMPLE
words) by lowest hash, drawn in one pass over *all* documents: every base span and every
ordinary word of each whole text is offered. Values are read whole; a prefix tree has
automaton.STATES states at most, and what lies deeper is counted along the merged
automaton. The second pass scores all candidates of all whole texts. Neither shuffles a
text. Defined cases: a null text is an empty one and has no span; a kind without labelled
values has no automaton, and a corpus without words is held against a uniform one; equal
texts give equal spans; an empty table gives an empty table; input columns that clash
with an output column are replaced by it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.automaton import CHARACTERS, PLACE, Tables, infer
from pointlake.llm.common import chunks, fresh, map_column, quoted, read_table, without

# The base patterns and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])")
SAMPLE, ORDINARY_SAMPLE, FALSE = 400, 2000, 1e-6
#: The chance that a value of a loop ends after a character.
LOOP_END = math.log(1 / 32)
#: Of every kind and of ordinary words, one value in so many is held back to set ``least``.
HELD = 5

# Alphabets, and public formats of credentials as constant parts and (alphabet, least length[, most]).
ALPHABETS = {
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "alnum": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
    "url": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_",
    "digits": "0123456789",
    "hex": "0123456789abcdef",
}
FORMATS: dict[str, tuple] = {
    "cloud key id": ("AKIA", ("upper", 16)),
    "cloud secret": (("base64", 40),),
    "code host token": ("ghp_", ("alnum", 36)),
    "code host access token": ("glpat-", ("url", 20)),
    "payment key": ("sk_live_", ("alnum", 24)),
    "chat bot token": ("xoxb-", ("digits", 10, 13), "-", ("digits", 10, 13), "-", ("alnum", 24)),
    "map key": ("AIza", ("url", 35)),
    "package token": ("npm_", ("alnum", 36)),
    "web token part": ("eyJ", ("url", 61)),
    "key of 256 bits": (("base64", 43), "="),
    "random name": (("lower", 25),),
    "recovery code": (("upper", 24),),
}

#: Identifiers that are no secrets, as made-up ordinary values.
UUID = (("hex", 8), "-", ("hex", 4), "-", ("hex", 4), "-", ("hex", 4), "-", ("hex", 12))

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

def base_spans(text: str) -> list[Span]:
    """Leftmost, not overlapping within a kind; matches that are too short use up their text but are dropped."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    return sorted(out)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def made_up(parts: Sequence, n: int, seed: str) -> list[str]:
    """``n`` values of a format."""
    pick = random.Random(seed)
    return ["".join(p if isinstance(p, str) else "".join(pick.choice(ALPHABETS[p[0]]) for _ in range(pick.randint(p[1], p[-1]))) for p in parts) for _ in range(n)]


def composed(words: Sequence[str]) -> list[str]:
    """Ordinary words as they are, and joined."""
    low = [w.lower() for w in words]
    at = lambda i: low[i % len(low)]
    return [x for i, w in enumerate(words) for x in (w, at(i) + at(7 * i + 1), at(i) + at(7 * i + 1) + at(13 * i + 2))]


def chained(words: Sequence[str]) -> list[str]:
    """What is commonly made of words: identifiers, paths, dates, names with numbers, rules and borders."""
    out, pick = [], random.Random("chained")
    shapes = (str.lower, str.lower, str.title, str.title, str.upper, lambda w: w[: pick.randrange(1, 4)].title(), lambda w: w[: pick.randrange(1, 4)].upper(), lambda w: "".join(pick.choice("0123456789") for _ in range(pick.randrange(1, 9))))
    for word in words:
        link, shape = pick.choice(("", "-", "_", "/", "_", "=")), pick.choice(shapes)
        parts = [shape(word)] + [(shape if pick.random() < 0.7 else pick.choice(shapes))(pick.choice(words)) for _ in range(pick.randrange(1, 6))]
        out.append(link.join(parts) if link or shape is str.title else parts[0] + "".join(pick.choice(("", "-", "_", "/", "=", "+")) + p for p in parts[1:]))
        if pick.random() < 0.1:
            line, corner = pick.choice("--=_+/"), pick.choice("++-=")
            out.append(pick.choice((corner, "")) + "".join(line * pick.randrange(1, 40) + corner for _ in range(pick.randrange(1, 8))))
    return out


@dataclass(frozen=True)
class Model:
    """Tables of the automata of whole values and of inner parts; the best of ``ordinary`` is the one to beat by ``least``."""

    whole: list[Tables]
    inner: list[Tables]
    ordinary: list[Tables]
    least: float = -math.log(FALSE)

    def gain(self, value: str) -> float:
        """Log likelihood as a credential against that as an ordinary run; minus infinity without automata."""
        if not self.whole:
            return -math.inf
        places = [PLACE.get(c, 0) for c in value]
        best = max(max(t.likelihood(places) for t in self.whole), max(t.likelihood(places, False) for t in self.inner) + LOOP_END)
        against = max((t.likelihood(places) for t in self.ordinary), default=-(len(value) + 1) * math.log(len(CHARACTERS)))
        return best - math.log(len(self.whole) + len(self.inner)) - against


def learned(values: dict[str, list[str]], ordinary: list[str]) -> Model:
    """The model of labelled values by kind and of ordinary words."""
    values = {k: v for k, v in sorted(values.items()) if v}
    words = sorted(set(ordinary))
    random.Random("words").shuffle(words)

    def fitted(values: dict[str, list[str]], words: list[str], least: float) -> Model:
        inner = {k: [x[len(x) // 2 :] for x in v] for k, v in values.items()}
        plain = [infer(composed(words)).tables(), infer(chained(words), last=True).tables(), infer(made_up(UUID, SAMPLE, "uuid")).tables()] if words else []
        return Model([infer(v).tables() for v in values.values()], [infer(v, ends=False).tables() for v in inner.values()], plain, least)

    least = -math.log(FALSE)
    if len(words) >= 2 * HELD:
        held = words[::HELD]
        trial = fitted(values, [w for i, w in enumerate(words) if i % HELD], least)
        least = max([least, *(trial.gain(x) for x in composed(held) + chained(held) if len(x) >= 16)])
    return fitted(values, words, least)


def covered(spans: list[Span]) -> list[tuple[int, int]]:
    """The union of spans as (start, end), in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def replaced(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with ``mark`` in place of each run that spans cover."""
    out, at = [], 0
    for a, b in covered(spans):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if out else text


def labelled(text: str, spans: list[Span]) -> list[tuple[str, str]]:
    """(kind, value) of the base spans."""
    return [(KINDS[k], ASSIGN.match(text[a:b])[2] if k == 0 else text[a:b]) for a, k, b in spans]


def ordinary(text: str, spans: list[Span]) -> list[str]:
    """All ordinary words that touch no base span."""
    return ORDINARY.findall(replaced(text, spans, "="))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, words: int = ORDINARY_SAMPLE, more: dict[str, list[str]] | None = None) -> Model:
    """The model of ``sample`` different values a kind (``words`` ordinary ones), those of the lowest hash over all documents, of made-up values of FORMATS and of ``more``, labelled values by kind.

    Every value is offered; each task passes on its lowest a kind, Spark keeps the
    lowest of 16 parts of the hash, and the driver the lowest of those.
    """
    schema = pa.schema([("kind", pa.string()), ("h", pa.string()), ("value", pa.string())])
    most = lambda kind: words if kind == "ordinary" else sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, str]] = {}
        seen: set[str] = set()
        for batch in batches:
            for texts in chunks(batch.column(0)):
                for text in texts:
                    spans = base_spans(text)
                    new = set(ordinary(text, spans)) - seen
                    seen |= new
                    for kind, value in [*labelled(text, spans), *(("ordinary", word) for word in new)]:
                        of = held.setdefault(kind, {})
                        of[hashlib.blake2b(value.encode(), digest_size=12).hexdigest()] = value
                        if len(of) > 4 * most(kind):
                            held[kind] = {h: of[h] for h in sorted(of)[: most(kind)]}
                    if len(seen) > 1 << 17:
                        seen.clear()
        rows = [(k, h, of[h]) for k, of in held.items() for h in sorted(of)[: most(k)]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], schema=schema)

    found = docs.select(quoted(text_col).alias("t")).mapInArrow(run, "kind string, h string, value string")
    # of each task at most the sample a kind; dealt by the last digit of the hash, 16 parts, and ranked in them
    near = found.distinct().withColumn("part", F.substring("h", -1, 1))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("kind", "part").orderBy("h")))
    kept = near.where(F.col("r") <= F.when(F.col("kind") == "ordinary", words).otherwise(sample)).select("kind", "h", "value")
    values: dict[str, list[tuple[str, str]]] = {}
    for r in kept.collect():  # 16 samples a kind at most
        values.setdefault(r.kind, []).append((r.h, r.value))
    found_ = {k: [v for _, v in sorted(of)[: most(k)]] for k, of in values.items()}
    plain = found_.pop("ordinary", [])
    made = {name: made_up(parts, sample, name) for name, parts in FORMATS.items()}
    return learned(found_ | made | (more or {}), plain)


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, base and format spans); runs that base spans cover by half or more are left to them."""
    base = base_spans(text)
    union, at, more = covered(base), 0, []
    for m in CANDIDATE.finditer(text):
        while at < len(union) and union[at][1] <= m.start():
            at += 1
        inside, i = 0, at
        while i < len(union) and union[i][0] < m.end():
            inside += min(m.end(), union[i][1]) - max(m.start(), union[i][0])
            i += 1
        if 2 * inside < len(m[0]) and model.gain(m[0]) >= model.least:
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more) if more else base


COLUMNS = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "n_format": "long"}


def scanned(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with counts a kind, the base spans' digest and all spans, in code points, ends excluded."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for texts in chunks(batch):
                for text in texts:
                    base, spans = all_spans(text, model)
                    counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
                    rows.append((*counts[:3], hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans), counts[3]))
            kinds = [pa.int64() if k == "long" else pa.string() for k in COLUMNS.values()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(COLUMNS))

    made = fresh(df, "secrets")
    rest = [quoted(c) for c in df.columns if c.lower() not in COLUMNS]
    out = map_column(df, text_col, run, ", ".join(f"{c} {k}" for c, k in COLUMNS.items()), made)
    return out.select(*rest, *[F.col(made)[c].alias(c) for c in COLUMNS])


def redacted(df: DataFrame, model: Model, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by ``mark``; overlapping spans are one. Null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [replaced(t, all_spans(t, model)[1], mark) for texts in chunks(batch) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(done, pa.string())], ["text"])

    made = fresh(df, "clean")
    out = map_column(df, text_col, run, "text string", made)
    value = F.when(quoted(text_col).isNotNull(), F.col(made)["text"])
    return out.select(*[value.alias(c) if c.lower() == text_col.lower() else quoted(c) for c in df.columns])


def op2_grammar_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without(scanned(docs, fit(docs)), ["text"])
