"""Token ids in a binary file format: concatenated ids and Elias-Fano document boundaries.

The corpus is range-partitioned by document id, so files hold ascending ids and only texts are shuffled, once.
A partition is cut into blocks of about BLOCK_IDS ids, each a record of the files:

    part, seq      partition, and block number in it
    first_doc      its first document id
    local_start    ids of the partition before this block
    n_docs, n_ids
    doc_ids        Elias-Fano code of the document ids
    bounds         Elias-Fano code of n_docs + 1 offsets into ids
    ids            unsigned 32-bit little-endian ids

A document's global offset is its partition's base (a running sum over partition totals), local_start and the
offset that select gives. Files are read in runs of RUN documents, whose offsets and ids select takes from the
codes; no table of a block's offsets is built.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import elias_fano
from .common import partitions

BLOCK_IDS = 1 << 20
#: Documents whose offsets are selected at a time.
RUN = 512
#: Pieces whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 600_000
# Letters that every Unicode version counts as such, and ASCII signs that neither start a contraction nor hold a letter or digit.
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я一-龥]+)([!-&(-/:-@\\[-`{-~]*)")
BLOCK = "part int, seq int, first_doc long, local_start long, n_docs long, n_ids long, doc_ids binary, bounds binary, ids binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("local_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("bounds", pa.binary()), ("ids", pa.binary())])


class Encoder(dict):
    """The tokenizers library, called once per distinct piece of text: piece -> ids.

    The byte-level split never crosses a lone space or line feed between two other characters: a space goes
    with the word that follows, and a line feed stands alone. Texts are cut there: a piece is a word with the
    space before it (not stored), or a line feed and the word after it. A word of letters, and the signs after
    it, are split from each other too, so they go to the library's model as they are; other words go through
    the whole library. Texts with any other white space beside a cut, or at an end, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.line = self._whole("\n")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.alphabet[32])

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, text: str, front: str = "") -> bytes:
        """Ids of a text that the split leaves whole; front is a space as the byte-level alphabet shows it."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(front + text)]).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        ids = self[piece] = self._ids(piece)
        return ids

    def _ids(self, piece: str) -> bytes | None:
        """None where the text must be encoded whole."""
        line = piece[:1] == "\n"
        if m := WORD.fullmatch(piece, line):
            letters, signs = m.groups()
            ids = self.get(piece[: line + len(letters)]) if signs else None
            if ids is None:
                ids = self.line + self._run(letters) if line else self._run(letters, self.space)
            return ids + self._run(signs) if signs else ids
        word = piece[1:] if line else piece
        if not word or len(word.split()) != 1 or word[0].isspace() or word[-1].isspace():
            return None
        return self.line + self._whole(word) if line else self._whole(" " + word)

    def word(self, word: str) -> bytes:
        """Ids of a word with a space before it; they are not kept."""
        ids = None if word[:1] == "\n" else self._ids(word)
        return self._whole(" " + word) if ids is None else ids

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    @property
    def begins(self) -> np.ndarray:
        """Whether each id begins with a space."""
        return np.array([(self.tokenizer.id_to_token(i) or "").startswith(self.space) for i in range(self.size)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            if len(self) > CACHE_WORDS:
                self.clear()
            try:
                out.append(b"".join(map(self.__getitem__, ("\n" + t).replace("\n", " \n").split(" ")[1:]))[4:])
            except TypeError:
                out.append(self._whole(t))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, with its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batches_of(texts: list[str], size: int = 1 << 22):
    """Slices of at most about size characters, so that very long texts are encoded on their own."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= size):
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def blocks(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def of(batches):
        enc, part, seq, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, bounds = [], [], [0]

        def block():
            row = [part, seq, doc_ids[0], start, len(doc_ids), bounds[-1], elias_fano.encode(np.array(doc_ids)), elias_fano.encode(np.array(bounds)), b"".join(ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for a, z in batches_of(texts):
                for name, code in zip(names[a:z], enc.encode(texts[a:z]), strict=True):
                    doc_ids.append(name)
                    ids += (code, end)
                    bounds.append(bounds[-1] + len(code) // 4 + 1)
                    if bounds[-1] >= block_ids:
                        yield block()
                        seq, start = seq + 1, start + bounds[-1]
                        ids, doc_ids, bounds = [], [], [0]
        if doc_ids:
            yield block()

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .filter("id is not null")
        .repartitionByRange(partitions(docs.sparkSession), "id")
        .sortWithinPartitions("id")
        .mapInArrow(of, BLOCK)
    )


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every text (null: empty), append end_id to each document, and write the files at path.

    Documents are in ascending id order over all files; rows that repeat an id follow each other. Rows
    without an id are left out. Other columns are ignored. An empty table writes no block.
    """
    blocks(docs, tokenizer, id_col, text_col, end_id).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document of the files: id_col, start (ids of all documents before it), n_tokens, ids_crc32, ids (binary, if asked for)."""
    stored = spark.read.schema(BLOCK).parquet(path)
    # one row per written partition: their number is that of the files, not of the documents
    bases = stored.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_doc").alias("first")).select(
        "part", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("base")
    )

    def of(batches):
        for b in batches:
            for row in b.to_pylist():
                names, bounds = elias_fano.EliasFano(row["doc_ids"]), elias_fano.EliasFano(row["bounds"])
                ids = memoryview(row["ids"])
                for at in range(0, len(names), RUN):
                    cuts = bounds.select_run(at, RUN + 1)
                    parts = [ids[4 * s : 4 * e] for s, e in pairwise(cuts.tolist())]
                    out = {id_col: names.select_run(at, RUN), "start": cuts[:-1] + row["local_start"] + row["base"], "n_tokens": np.diff(cuts), "ids_crc32": np.array([zlib.crc32(p) for p in parts])}
                    if with_ids:
                        out["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    return (
        stored.join(F.broadcast(bases), "part")
        .select("local_start", "base", "doc_ids", "bounds", "ids")
        .mapInArrow(of, f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    )
