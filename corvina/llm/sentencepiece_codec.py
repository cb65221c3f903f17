"""SentencePiece encoding and decoding through a table of distinct chunks.

In the models meant here no piece holds a whitespace marker behind another character, nor a line feed. A text
therefore falls apart into chunks (a run of markers with the word behind it, or a line feed) that are segmented
independently of each other. Each task keeps a table of the chunks met so far, with their ids and their decoded
text; every distinct chunk goes through the library once, and a text's ids are the table's entries in order of
position. The table is emptied when it is full, so memory is bounded; chunks of over ``LONGEST`` characters (long addresses, say)
are segmented for the texts at hand and then forgotten, while the others stay. Both properties of the vocabulary are checked
when the model is loaded; a model without them is applied to whole texts.

Null and empty texts: only the end id; decoded ''. Repeated rows: one result each. Texts and chunks of any length are
taken whole. There are no ties. Empty tables give empty results, extra columns are left alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Characters of a chunk and number of chunks that a table keeps; bytes of text that are looked up together.
LONGEST, ENTRIES, TOGETHER = 64, 300_000, 1 << 20


class ChunkCodec:
    def __init__(self, model: bytes, entries: int = ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.pieces = [None if self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) else p.replace(MARK, " ") for i, p in enumerate(pieces)]
        self.head = self.sp.encode("\n")
        self.separable = (
            not any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces)
            and self.sp.encode("") == []
            and self.sp.encode("\n▁ \n")[: len(self.head)] == self.head
            and self.sp.decode(self.head) == "\n"
            and self.sp.encode(" \n ") != self.sp.encode("\n")  # white space is kept
        )
        self.eos = array("i", [self.sp.eos_id()]).tobytes()
        self.entries, self.ids, self.text = entries, {}, {}

    def learn(self, chunks: Iterable[str], ids: dict, text: dict) -> None:
        """A line feed is put before each chunk, as the library adds a marker only at the start."""
        chunks, n = list(chunks), len(self.head)
        found = self.sp.encode(["\n" + c.replace(MARK, " ") for c in chunks], num_threads=1)
        pieces = self.pieces
        for c, x in zip(chunks, found, strict=True):
            ids[c] = array("i", x[n:]).tobytes()
            try:
                text[c] = "".join([pieces[i] for i in x[n:]])
            except TypeError:  # bytes, which the library puts together
                text[c] = self.sp.decode(x)[1:]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as 32-bit integers, and the ids decoded."""
        if not self.separable:
            for t in texts:
                x = self.sp.encode(t or "", add_eos=True)
                yield array("i", x).tobytes(), self.sp.decode(x)
            return
        chunked = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*chunked).difference(self.ids)
        aside = {c for c in new if len(c) > LONGEST}  # for these texts only
        if len(self.ids) + len(new) - len(aside) > self.entries:
            self.ids.clear(), self.text.clear()
            new = set().union(*chunked)
            aside = {c for c in new if len(c) > LONGEST}
            if len(new) - len(aside) > self.entries:
                aside = new
        if new:
            self.learn(new, self.ids, self.text)
        ids, text = self.ids, self.text
        for chunks in chunked:
            yield b"".join([*map(ids.__getitem__, chunks), self.eos]), "".join(map(text.__getitem__, chunks))[1:]
        for c in aside:
            del ids[c], text[c]


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", entries: int = ENTRIES) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for each row. The model (a fixed file of about half a MB) is sent to the
    tasks, so executors need not have the file. No shuffle."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model.value, entries)
        names = ["doc_id", "ids", "decoded"]

        def made(keys: pa.Array, ids: tuple, texts: tuple) -> pa.RecordBatch:
            at, ends = 0, [0]
            for x in ids:
                ends.append(at := at + len(x) // 4)
            flat = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(ids))])
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(texts, pa.string())], names)

        for batch in batches:
            column, start, size = batch.column(1), 0, 0
            lengths = pc.binary_length(column).fill_null(0).to_pylist()
            for end, n in enumerate(lengths, 1):
                size += n
                if size > TOGETHER or end == len(lengths):
                    ids, texts = zip(*codec.encode(column.slice(start, end - start).to_pylist()), strict=True)
                    yield made(batch.column(0).slice(start, end - start), ids, texts)
                    start, size = end, 0

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from those of :func:`encode`."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
