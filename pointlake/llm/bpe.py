"""Byte-level BPE encoding and decoding of whole texts.

The vocabulary is a file of ranks (base64 token, space, rank). The driver derives
from it a model for the ``tokenizers`` library: bytes become printable characters,
and each token's merge is the last step by which the lower ranks build its bytes.
That model (its size is the vocabulary's, not the data's) is shipped to the
workers, which encode Arrow batches in runs of bounded size. No shuffle, no state:
a lost executor costs the batches it held.

Defined cases: a null or empty text has no tokens; a text of any length is encoded
in pieces that end where the pattern ends a match anyway; strings of special tokens
are ordinary text; equal rows give equal results; an empty table gives an empty
table; input columns that clash with an output column are replaced by it; decoding
null or an unknown id gives null.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import chunks, fresh, in_parts, map_column, quoted, read_table, without

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of one piece of a long text, and of all texts encoded by one call.
PIECE, RUN = 1 << 16, 1 << 18
#: A blank after anything but white space: every match of the pattern ends before it.
SAFE_CUT = re.compile(r"(?<=\S)\x20")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one past Latin-1."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    table = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [table[b] for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merges below ``token``'s own rank leave of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= ranks[token]:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model_json(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> str:
    """The ranks as a serialised byte-level model of the ``tokenizers`` library."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    spell = lambda token: "".join(shown[b] for b in token)
    merges = [(spell(m[0]), spell(m[1])) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := last_merge(t, ranks))]
    made = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    if pattern == public_tokenizers.PATTERN:  # built into the byte-level splitter
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    else:
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


def pieces(text: str, most: int = PIECE) -> list[str]:
    """``text`` cut where any match ends; longer than ``most`` only where there is no such place."""
    out, start = [], 0
    while len(text) - start > most:
        at = SAFE_CUT.search(text, start + most)
        if not at:
            break
        out.append(text[start : at.start()])
        start = at.start()
    return [*out, text[start:]]


class Codec:
    """Encodes and decodes with one model; made once per worker process."""

    _kept: dict[str, "Codec"] = {}

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = {i: bytes(byte_of[c] for c in shown) for shown, i in vocab.items()}

    @classmethod
    def of(cls, model: str) -> "Codec":
        key = hashlib.sha256(model.encode()).hexdigest()
        if key not in cls._kept:
            cls._kept[key] = cls(model)
        return cls._kept[key]

    def encode(self, texts: list[str], offsets: bool = False) -> Iterator[list[tuple[list[int], list[tuple[int, int]] | None]]]:
        """For each text the list of its pieces' (ids, offsets in characters of the text)."""
        call = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        cut = [pieces(t) for t in texts]
        flat = [p for ps in cut for p in ps]
        done: list = []
        start = 0
        while start < len(flat):
            end, held = start, 0
            while end < len(flat) and (end == start or held + len(flat[end]) <= RUN):
                held += len(flat[end])
                end += 1
            done += [(e.ids, e.offsets if offsets else None) for e in call(flat[start:end], add_special_tokens=False)]
            start = end
            while cut and len(done) >= len(cut[0]):
                own, parts = done[: len(cut[0])], cut.pop(0)
                done = done[len(parts) :]
                if offsets:
                    at, moved = 0, []
                    for (ids, spans), part in zip(own, parts):
                        moved.append((ids, [(a + at, b + at) for a, b in spans]))
                        at += len(part)
                    own = moved
                yield own

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as its characters become whole; a character split over tokens waits for its last byte."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := held.decode(self.bytes_of[i]):
                yield piece
        if rest := held.decode(b"", final=True):
            yield rest


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``ids``, ``starts`` and ``ends``: the tokens and the characters each one covers.

    A character split over several tokens is covered by each of them.
    """
    model = model_json(read_ranks(ranks_path or public_tokenizers.path(RANKS)), pattern)
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(model)
        for batch in batches:
            ids, starts, ends = [], [], []
            for texts in chunks(batch):
                for own in codec.encode(texts, offsets=True):
                    spans = np.array([s for _, x in own for s in x], dtype=np.int32).reshape(-1, 2)
                    ids.append(np.concatenate([np.asarray(i, dtype=np.int32) for i, _ in own]))
                    starts.append(spans[:, 0])
                    ends.append(spans[:, 1])
            yield pa.StructArray.from_arrays([pa.array(x, kind) for x in (ids, starts, ends)], ["ids", "starts", "ends"])

    made = fresh(df, "bpe")
    names = ["ids", "starts", "ends"]
    out = map_column(df, text_col, run, "ids array<int>, starts array<int>, ends array<int>", made)
    rest = [quoted(c) for c in df.columns if c.lower() not in names]
    return out.select(*rest, *[F.col(made)[n].alias(n) for n in names])


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """``df`` with the text of ``ids_col``; bytes that are no UTF-8 become U+FFFD."""
    model = model_json(read_ranks(ranks_path or public_tokenizers.path(RANKS)))

    def text(codec: Codec, ids: list[int] | None) -> str | None:
        known = ids is not None and all(i in codec.bytes_of for i in ids)
        return "".join(codec.stream(ids)) if known else None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(model)
        for batch in batches:
            yield pa.StructArray.from_arrays([pa.array([text(codec, x.as_py()) for x in batch], pa.string())], ["text"])

    made = fresh(df, "text")
    out = map_column(df, ids_col, run, "text string", made)
    rest = [quoted(c) for c in df.columns if c.lower() != out_col.lower()]
    return out.select(*rest, F.col(made)["text"].alias(out_col))


def digests(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the round trip, and ``ids`` if asked for.

    Tokens are hashed and decoded where they are made, so that the decoded text
    does not have to leave the worker.
    """
    model = model_json(read_ranks(ranks_path or public_tokenizers.path(RANKS)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(model)
        for batch in in_parts(batches):
            counts, ids_hex, text_hex, kept = [], [], [], []
            for texts in chunks(batch):
                for own in codec.encode(texts):
                    n, of_ids, of_text, parts = 0, hashlib.sha256(), hashlib.sha256(), []
                    for ids, _ in own:
                        n += len(ids)
                        parts.append(np.asarray(ids, dtype="<u4"))
                        of_ids.update(parts[-1].tobytes())
                        of_text.update(codec.decode(ids))
                    if with_ids:
                        kept.append(np.concatenate(parts).astype(np.int32))
                    counts.append(n)
                    ids_hex.append(of_ids.hexdigest())
                    text_hex.append(of_text.hexdigest())
            columns = [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string()), pa.array(kept, pa.list_(pa.int32()))]
            yield pa.StructArray.from_arrays(columns[: len(names)], names)

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + with_ids]
    made = fresh(df, "bpe")
    out = map_column(df, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, made)
    rest = [quoted(c) for c in df.columns if c.lower() not in names]
    return out.select(*rest, *[F.col(made)[n].alias(n) for n in names])


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without(digests(docs), ["text"])
