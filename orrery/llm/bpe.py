"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For each prefix of a pre-token there is just one last token in its encoding.
An automaton over the vocabulary lists the tokens that end at each byte, the
longest first; the one that may follow the last token of the prefix before it
is stored, and the back-pointers give the ids. Two tokens may stand side by
side if undoing their merges, latest first, never uncovers a pair at the
border that the merge order would have joined earlier.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import free, table

#: Fixed value: how byte-level tokenizers of this family cut a text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 64
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """A vocabulary with ordered merges, from the text of a tokenizers JSON file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        vocab: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.content: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.content[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.content[i] = token.encode()
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.joined: dict[tuple[int, int], int] = {}
        for at, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = at, x, y
            self.joined.setdefault((x, y), made)
        del data
        self.fits: dict[tuple[int, int], bool] = {}
        self.ends = ahocorasick.Automaton()
        for i in vocab.values():
            if self.content[i] and (len(self.content[i]) == 1 or self.rank[i] >= 0 and self._beside(self.left[i], self.right[i], self.rank[i])):
                self.ends.add_word(self.content[i].decode("latin-1"), (i, len(self.content[i])))
        self.ends.make_automaton()
        self.pretokens = regex.compile(PRETOKEN).findall
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known = _Known(self)

    def _beside(self, a: int, b: int, before: int = _NEVER) -> bool:
        """True if a and b stay apart: no pair at their border merges before the later of its sides is made."""
        rank, joined = self.rank, self.joined
        while True:
            made = joined.get((a, b))
            if made is not None and rank[made] < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        if (found := self.fits.get((a, b))) is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            found = self.fits[a, b] = self._beside(a, b)
        return found

    def last_tokens(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        last, back = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end, (token, size) in self.ends.iter(piece.decode("latin-1")):
            if last[end + 1] < 0 and (end + 1 == size or last[end + 1 - size] >= 0 and self.compatible(last[end + 1 - size], token)):
                last[end + 1], back[end + 1] = token, end + 1 - size
        at, ids = len(piece), []
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, out, at = self.known, [], 0
        if len(known) > REMEMBERED:
            known.clear()
        for hit in self.cut.finditer(text) if self.cut else ():
            out.extend(map(known.__getitem__, self.pretokens(text[at : hit.start()])))
            out.append(self.special[hit[0]].to_bytes(4, "little"))
            at = hit.end()
        out.extend(map(known.__getitem__, self.pretokens(text[at:] if at else text)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.content.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    """Pre-token -> its ids as bytes."""

    def __init__(self, model: BpeModel):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.model.last_tokens(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


_models: dict[int, BpeModel] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mapped(docs: DataFrame, path: str | None, schema: str, work) -> DataFrame:
    """Run ``work(model, batch)`` on small slices of the batches; the vocabulary file goes out as one broadcast."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if model is None:
                spec = sent.value
                model = _models.get(hash(spec))
                if model is None:
                    _models.clear()
                    model = _models[hash(spec)] = BpeModel(spec)
            for at in range(0, batch.num_rows, 256):
                yield work(model, batch.slice(at, 256))

    return docs.mapInArrow(run, schema)


def _sent(rows: DataFrame, column: str, made: str, kind: str, keep: bool) -> tuple[DataFrame, int, list[int], str]:
    """What goes to the workers, each column once: the rows, the place of ``column``, the places that come back, the schema with ``made`` behind.

    A column that is already called ``made`` stays only as input.
    """
    fields = rows.schema.fields
    at = next((i for i, f in enumerate(fields) if f.name == column), -1)
    if at < 0 or fields[at].dataType.simpleString() != kind:
        # Another type or a path into a struct: a column of its own.
        name = free(rows, "__in")
        rows = rows.withColumn(name, F.col(column).cast(kind))
        fields, at = rows.schema.fields, len(fields)
        back = [i for i in range(at) if keep or fields[i].name != column]
    else:
        back = [i for i, f in enumerate(fields) if keep or i != at]
    back = [i for i in back if fields[i].name.lower() != made]
    used = sorted({at, *back})
    rows = rows.select(*[rows[f"`{fields[i].name.replace('`', '``')}`"] for i in used])
    return rows, used.index(at), [used.index(i) for i in back], ", ".join(f"`{fields[i].name.replace('`', '``')}` {fields[i].dataType.simpleString()}" for i in back)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, keep: bool = True) -> DataFrame:
    """All columns of ``docs``, and ids (little-endian unsigned 32-bit integers as binary; null text: none).

    A column that is already called ids is replaced. Without ``keep`` the text
    does not come back: it need not go through the workers twice.
    """
    rows, at, back, schema = _sent(docs, text, "ids", "string", keep)

    def work(model: BpeModel, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([model.encode(t or "") for t in batch.columns[at].to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*[batch.columns[i] for i in back], ids], [*[batch.schema.names[i] for i in back], "ids"])

    return _mapped(rows, path, f"{schema}, ids binary" if schema else "ids binary", work)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of ``rows``, and decoded: the text of its ids (null ids: empty)."""
    rows, at, back, schema = _sent(rows, ids, "decoded", "binary", True)

    def work(model: BpeModel, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([model.decode(x or b"") for x in batch.columns[at].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*[batch.columns[i] for i in back], texts], [*[batch.schema.names[i] for i in back], "decoded"])

    return _mapped(rows, path, f"{schema}, decoded string" if schema else "decoded string", work)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decode(encode(docs, keep=False))
    return rows.select(
        "doc_id",
        F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
