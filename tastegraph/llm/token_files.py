"""Token sequences in Arrow files of fixed-size lists.

Documents are taken in ascending doc_id order, encoded, closed with an end id and
packed back to back into sequences of equal length. Each range of doc_ids becomes one
Arrow IPC file in the random-access layout: a record batch holds the columns
``ids fixed_size_list<uint16|uint32>[L]`` and ``mask fixed_size_list<bool>[L]`` (false
on the padding that ends a file), so a memory map gives sequence k of a batch without
copying. A Parquet manifest beside the files names for each document its file, its
offset there and its length.

A task writes to a name of its own and then moves the file into place, so a task that
runs again after a lost executor replaces the same file with the same bytes.

Nulls, blanks: a null text counts as empty and yields the end id alone; null doc_ids come
first; rows that repeat a doc_id are all kept, ordered by the XXH64 of their text. An empty table gives
no files and an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.llm.bpe import byte_alphabet
from tastegraph.llm.labelled import map_rows
from tastegraph.llm.pieces import RARE, PieceMemo, blocks
from tastegraph.plans.scratch import scratch_path

END_ID = 2
SEQ_LEN = 2048
BATCH_SEQS = 64
#: Bytes that a worker's memory of pieces may take, about.
MEMO_BYTES = 192 << 20
#: Words that the library reads in one call.
CALL = 4000
# Pieces begin with the white space before them; no token of a byte-level vocabulary
# spans from a visible character into white space, so pieces can be encoded apart.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct piece.

    The vocabulary's own splitting keeps a blank with what follows it and a lone line end for
    itself, so most texts are cut at blanks: a piece is a word whose blank is left out, or a line
    end with the first word of its line. Such pieces are read many in one call, as one text, and
    told apart by the blank or line end that begins each. A text with longer runs of white space,
    or with rarer kinds, is cut where white space begins; its pieces, marked by two line ends,
    stand for themselves and go through the library one by one.

    The pieces of a block of texts become a dictionary-encoded Arrow array, so the memory of pieces
    is asked once for each distinct one of the block, and the ids are gathered by numpy. The memory
    is emptied when it has grown to MEMO_BYTES.
    """

    _known: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size()
        self.kind = np.uint16 if size <= 65536 else np.uint32
        signs = byte_alphabet()
        self.starts = np.array([(self.tok.id_to_token(i) or "").startswith((signs[32], signs[10])) for i in range(size)])
        self.memo = PieceMemo(self.kind, MEMO_BYTES)

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, pieces: list[str], texts: list[str]) -> None:
        each = [np.array(x, self.kind) for x in self._ids(texts)]
        self.memo.keep(pieces, np.concatenate([np.zeros(0, self.kind), *each]), np.array([len(x) for x in each], np.int64))

    def learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if p[:2] != "\n\n" and p != "\n"]
        for at in range(0, len(words), CALL):
            part = words[at : at + CALL]
            ids = np.array(self._ids([(" " + " ".join(part)).replace(" \n", "\n")])[0], self.kind)
            cut = np.flatnonzero(self.starts[ids])
            if len(cut) == len(part) and not cut[0]:
                self.memo.keep(part, ids, np.diff(cut, append=len(ids)))
            else:
                self._one_by_one(part, [p if p[0] == "\n" else " " + p for p in part])
        if len(words) < len(pieces):
            rest = [p for p in pieces if p[:2] == "\n\n" or p == "\n"]
            self._one_by_one(rest, [p[2:] if p[:2] == "\n\n" else p for p in rest])

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts, a line end before each, and their number for each text."""
        arrays, counts, run = [], [], []

        def flush() -> None:
            if run:
                arrays.append(pc.list_flatten(pc.split_pattern(pa.array(["".join(run)], pa.large_string()), " "))[1:])
                run.clear()

        for t in texts:
            if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[:1].isspace() or t[-1:] == " " or RARE.search(t):
                flush()
                own = ["\n", *("\n\n" + p for p in _PIECE.findall(t))]
                arrays.append(pa.array(own, pa.large_string()))
                counts.append(len(own))
            else:
                run.append(" \n" + t.replace("\n", " \n"))
                counts.append(run[-1].count(" "))
        flush()
        return pa.concat_arrays(arrays), np.array(counts, np.int64)

    def encode(self, texts: list[str], end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, sizes) for blocks of texts in order; ids are those of all texts of the block, each closed with the end id."""
        for part in blocks(texts, 4 << 20):
            pieces, counts = self._pieces(part)
            ids, until = self.memo.gather(pieces, self.learn)
            # The line end before each text gives its place to the end id of the text before.
            begins = np.concatenate(([0], until[np.cumsum(counts)[:-1] - 1]))
            ids[begins] = end_id
            yield np.concatenate([ids[1:], np.array([end_id], self.kind)]), np.diff(begins, append=until[-1])


def _schema(kind: type, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Sink:
    """One Arrow file: takes ids in order, writes full batches of sequences."""

    def __init__(self, folder: str, part: int, kind: type, length: int):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.temp, self.path = f"{base}/.{uuid.uuid4().hex}", f"{base}/part-{part:06d}.arrow"
        self.length, self.schema, self.kind = length, _schema(kind, length), kind
        self.out = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.length * BATCH_SEQS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        """Write what is held in batches of BATCH_SEQS sequences; the last may hold fewer, and ends in padding."""
        ids, per = np.concatenate([np.zeros(0, self.kind), *self.held]), self.length * BATCH_SEQS
        whole = len(ids) if last else len(ids) - len(ids) % per
        for at in range(0, whole, per):
            body = ids[at : min(whole, at + per)]
            mask = np.ones(len(body) + -len(body) % self.length, bool)
            mask[len(body) :] = False
            body = np.concatenate([body, np.zeros(len(mask) - len(body), self.kind)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (body, mask)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.held, self.n = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        self.fs.move(self.temp, self.path)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the files under ``folder`` and return the manifest ``(part, doc_id, seq, at, n_tokens)``.

    ``part`` orders the files, ``seq`` a document in its file, ``at`` is its first id there.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, sink, at, seq = PieceEncoder.of(tokenizer), TaskContext.get().partitionId(), None, 0, 0
        for pdf in batches:
            if sink is None:
                sink = _Sink(f"{folder}/ids", part, enc.kind, seq_len)
            lengths = []
            for ids, sizes in enc.encode(pdf["text"].tolist(), end_id):
                sink.add(ids)
                lengths.append(sizes)
            lengths = np.concatenate([np.zeros(0, np.int64), *lengths])
            starts = at + np.cumsum(lengths) - lengths
            yield pd.DataFrame({"part": part, "doc_id": pdf["doc_id"], "seq": np.arange(seq, seq + len(pdf)), "at": starts, "n_tokens": lengths})
            at, seq = at + int(lengths.sum()), seq + len(pdf)
        if sink:
            sink.close()

    # A doc_id that stands in many rows is dealt to several files by the hash of the text, and equal rows by their place in the input.
    order = ["doc_id", "_h", "_m"]
    keyed = source.withColumns({"_h": F.xxhash64("text"), "_m": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(files_of(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = map_rows(dealt, run, "part int, seq long, at long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def files_of(docs: DataFrame) -> int:
    """One file for each split of the input, so that files stay as large as splits, and no fewer than the tasks of a shuffle."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def open_token_file(folder: str, part: int) -> pa.ipc.RecordBatchFileReader:
    """A reader on one file; memory-mapped where the folder is local to the machine."""
    system, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/ids/part-{part:06d}.arrow"
    local = isinstance(system, pafs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))


def read_ids(reader: pa.ipc.RecordBatchFileReader, at: int, n: int) -> np.ndarray:
    """``n`` ids from position ``at`` of a file; a view where they lie in one batch."""
    length = reader.schema.field("ids").type.list_size
    per, out = length * BATCH_SEQS, []
    while n > 0:
        flat = reader.get_batch(at // per).column("ids").values.to_numpy(zero_copy_only=True)
        take = flat[at % per : at % per + n]
        out.append(take)
        at, n = at + len(take), n - len(take)
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, with the crc taken of ids read from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each file, so the running total is over file sizes, not documents.
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, reader = None, None
        for pdf in batches:
            crcs = []
            for p, at, n in zip(pdf["part"], pdf["at"], pdf["n_tokens"]):
                if p != part:
                    part, reader = p, open_token_file(folder, int(p))
                crcs.append(zlib.crc32(read_ids(reader, int(at), int(n)).astype("<u4").tobytes()))
            yield pd.DataFrame({"part": pdf["part"], "doc_id": pdf["doc_id"], "at": pdf["at"], "n_tokens": pdf["n_tokens"], "ids_crc32": crcs})

    # A manifest file holds one part's rows in order, so this reads each token file once.
    read = map_rows(manifest, run, "part int, at long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files and return the digests read back from them."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer, **options)
    return read_digests(docs.sparkSession, folder)
