"""Token ids in a compact file format: canonical length-limited Huffman codes over blocks with bit-offset checkpoints.

Texts are encoded with a public tokenizer (a file of the tokenizers library; its path is a parameter), END is appended,
and the ids are written in ascending order of doc_id. The format is a folder of two Parquet tables that any store holds:

* `codebook`: one row, the code length of every id (bytes; 0: not used). Codes are canonical: ascending by length, then id.
* `blocks`: part, seq (blocks in ascending order of both hold the documents in order), doc_ids, doc_lens, n_tokens,
  checkpoints (bit offset of every STEP-th token, unsigned 32 bits) and payload (codes, highest bit first).

Every block decodes on its own. Decoding is driven by one table of 2^MAX_BITS entries (or more, up to 2^25, where the ids in
use are more than that) and runs all stretches between checkpoints of many blocks in step. Code lengths come from the counts
of all ids of the corpus, at most MAX_BITS long by package-merge.

Null texts count as empty: their only id is END. Rows that repeat a doc_id stay rows of their own, in a fixed order; null
ids come first. Extra columns are left out. An empty table gives an empty folder and no rows. Special tokens' strings in a
text are encoded as the tokenizer does.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import chunks, shared_dir, stage

END, MAX_BITS, STEP, BLOCK_TOKENS = 2, 16, 256, 65_536
#: Pieces remembered in each of two generations of a worker's cache, about 150 bytes each, and the most bytes of them.
MAX_CACHED, MAX_CACHED_BYTES = 600_000, 50_000_000
#: A character that stands between pieces encoded together; pieces that hold it are encoded alone.
BETWEEN, TOGETHER = "\x7f", 64
#: Bytes of text looked at at once.
CHUNK = 4_000_000
_tokenizers: dict[str, tuple] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of bytes: blanks, letters, digits, other ASCII signs, the apostrophe, and whatever is left to the tokenizer.
_BLANK, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _FOREIGN = range(6)
_CLASS = np.full(256, _FOREIGN, dtype=np.uint8)
_CLASS[:128] = _SIGN
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _APOSTROPHE
#: By the classes of two neighbours (8 * first + second): whether the tokenizer's pattern always ends a match between them.
_CUT = np.zeros(256, dtype=bool)
for _a, _seconds in {_LETTER: (_DIGIT, _SIGN, _APOSTROPHE), _DIGIT: (_LETTER, _DIGIT, _SIGN, _APOSTROPHE), _SIGN: (_LETTER, _DIGIT)}.items():
    _CUT[[8 * _a + _b for _b in _seconds]] = True
_STARTS, _ENDS = _CUT.copy(), _CUT.copy()
_STARTS[8 * _BLANK + 1 : 8 * _BLANK + 6] = True
_ENDS[[8 * c + _BLANK for c in range(1, 6)]] = True
_CLASS, _STARTS, _ENDS = _CLASS.tobytes(), _STARTS.tobytes(), _ENDS.tobytes()  # tables of bytes.translate
_BLANKS = b"\t\n\x0b\x0c\r "
_AT_BLANK = re.compile(rb"[\t-\r ]")
#: Pieces that are one match of the tokenizer's pattern, whatever stands beside them.
_ONE_MATCH = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: What a tokenizer must do with texts for these cuts to hold.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def pieces(blob: bytes, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where the pieces of a UTF-8 text start, their lengths, and the pieces themselves one after another.

    The tokenizer joins nothing across a piece's ends. A-Z and the capitals of Latin-1 are lower-cased unless something
    follows that might combine with them. Words that hold one of `specials` are one piece, as they are.
    """
    text = b" " + blob + b" "
    buf = np.frombuffer(text, dtype=np.uint8)
    kind = np.frombuffer(bytearray(text.translate(_CLASS)), dtype=np.uint8)
    latin = np.flatnonzero(buf == 0xC3) + 1
    latin = latin[(buf[latin] != 0x97) & (buf[latin] != 0xB7)]  # the signs of multiplication and division
    kind[latin - 1] = kind[latin] = _LETTER
    blanks = np.flatnonzero(kind == _BLANK) if any(s in blob for s in specials) else None
    for special in specials:
        at = blob.find(special)
        while at >= 0:
            i = int(np.searchsorted(blanks, at + 1))
            kind[blanks[i - 1] + 1 : blanks[i]] = _FOREIGN
            at = blob.find(special, int(blanks[i]) - 1)
    plain = kind != _FOREIGN
    capital = (buf - np.uint8(65) < 26) & plain
    capital[:-1] &= plain[1:]
    low = buf | capital.view(np.uint8) << 5
    latin = latin[(buf[latin] < 0x9F) & plain[latin] & plain[latin + 1]]
    low[latin] += 32
    pair = (kind[:-1] << 3 | kind[1:]).tobytes()
    starts, ends = (np.flatnonzero(np.frombuffer(pair.translate(table), dtype=bool)) for table in (_STARTS, _ENDS))
    return starts, ends - starts, low.tobytes().translate(None, _BLANKS)


class Encoder:
    """Ids of whole texts as unsigned integers of `width` bytes.

    Texts are cut where this tokenizer's pattern always ends a match (`pieces`), and each distinct piece is encoded once and
    remembered. Texts of a tokenizer that normalizes or splits in another way are encoded whole.
    """

    def __init__(self, path: str):
        # A task has one core; the library's own threads would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        rules = json.loads(self.tokenizer.to_str())
        added = rules["added_tokens"]
        parts = [(rules[k] or {}).get(inside) for k, inside in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or not a["content"] or _AT_BLANK.search(a["content"].encode()) for a in added)
        self.cuts = parts == [_NORMALIZERS, _PRETOKENIZERS] and plain and not rules["truncation"] and not rules["padding"]
        self.specials = tuple(a["content"].encode() for a in added)
        mark = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        #: Ids that end a match, if the model marks them.
        self.last = np.zeros(1 << 8 * self.width if self.width == 2 else self.tokenizer.get_vocab_size(), dtype=bool)
        suffix = rules["model"].get("end_of_word_suffix")
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, some: list[bytes], ids: np.ndarray, begins: list[int], ends: list[int]) -> None:
        data, w = ids.tobytes(), self.width
        for piece, b, e in zip(some, begins, ends, strict=True):
            self.known[piece] = data[w * b : w * e]
        self.held += sum(map(len, some)) + len(data)

    def learn(self, new: list[bytes]) -> None:
        """Encode pieces that aren't known, many at once: a call costs more than a piece does."""
        single, mixed, alone = [], [], []
        for piece in new:
            if piece.isalpha() and piece.islower() or _ONE_MATCH.fullmatch(piece):  # bytes: ASCII only
                single.append(piece)
            elif self.mark is None or BETWEEN.encode() in piece:
                alone.append(piece)
            else:
                mixed.append(piece)
        for i in range(0, len(single), 256 * TOGETHER):
            groups = [single[j : j + TOGETHER] for j in range(i, min(i + 256 * TOGETHER, len(single)), TOGETHER)]
            for group, ids in zip(groups, self._batch([b" ".join(g).decode() for g in groups]), strict=True):
                ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
                if len(ends) == len(group) and ends[-1] == len(ids):
                    self._keep(group, ids, [0, *ends[:-1]], ends)
                else:  # a model without marks
                    mixed += group
        for i in range(0, len(mixed), 256 * TOGETHER):
            groups = [mixed[j : j + TOGETHER] for j in range(i, min(i + 256 * TOGETHER, len(mixed)), TOGETHER)]
            for group, ids in zip(groups, self._batch([f" {BETWEEN} ".join(p.decode() for p in g) for g in groups]), strict=True):
                cuts = np.flatnonzero(ids == self.mark).tolist()
                self._keep(group, ids, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)])
        for piece, ids in zip(alone, self._batch([p.decode() for p in alone]), strict=True):
            self._keep([piece], ids, [0], [len(ids)])

    def _ids(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all blobs one after another, and where each blob's end."""
        starts, lengths, data = pieces(b" ".join(blobs), self.specials)
        if not len(starts):
            return np.empty(0, dtype=self.kind), np.zeros(len(blobs), dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, bounds, held = found.dictionary.buffers()
        bounds, held = np.frombuffer(bounds, dtype=np.int32)[: len(found.dictionary) + 1].tolist(), held.to_pybytes()
        distinct = [held[b:e] for b, e in pairwise(bounds)]
        if len(self.known) > MAX_CACHED or self.held > MAX_CACHED_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        values = [*map(self.known.get, distinct)]
        missing = [i for i, v in enumerate(values) if v is None]
        new = []
        for i in missing:
            ids = self.older.get(distinct[i])
            if ids is None:
                new.append(distinct[i])
            else:
                self.known[distinct[i]] = ids
                self.held += len(distinct[i]) + len(ids)
        self.learn(new)
        for i in missing:
            values[i] = self.known[distinct[i]]
        pool = np.frombuffer(b"".join(values), dtype=self.kind)
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // self.width
        which = found.indices.to_numpy()
        n = sizes[which]
        upto = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - n), n)
        at += np.arange(len(at))
        ends = np.cumsum([len(b) + 1 for b in blobs])
        return pool[at], np.concatenate(([0], upto))[np.searchsorted(starts, ends - 1)]

    def encode(self, blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Number of ids of each text (UTF-8), END included, and all their ids; for some texts at a time."""
        for begin, end in chunks(blobs, CHUNK):
            some = blobs[begin:end]
            if not self.cuts:
                found = self._batch([b.decode() for b in some])
                ids, ends = np.concatenate(found), np.cumsum([len(x) for x in found])
            elif len(some) == 1:
                ids = np.concatenate([self._ids([part])[0] for part in slices(some[0])])
                ends = np.array([len(ids)])
            else:
                ids, ends = self._ids(some)
            yield np.diff(ends, prepend=0) + 1, np.insert(ids, ends, END)


def slices(blob: bytes, size: int | None = None) -> Iterator[bytes]:
    """A long text in parts of about `size` bytes that blanks separate."""
    begin, size = 0, size or CHUNK
    while blank := _AT_BLANK.search(blob, begin + size):
        yield blob[begin : blank.start()]
        begin = blank.end()
    yield blob[begin:]


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n (ids with END) and ids (bytes) of every row of docs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in parts:
            done = 0
            for n, ids in e.encode(part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()):
                packed = _bytes_of(ids, np.concatenate(([0], np.cumsum(n))))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(done, len(n)), pa.array(n), packed], names=["doc_id", "n", "ids"])
                done += len(n)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, ids binary")


# --- the code -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Length of each symbol's code, 0 where its count is 0; optimal among codes of at most `most` bits, or of as many as
    the number of symbols takes, if that is more."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    most = max(most, int(max(1, len(used) - 1)).bit_length())
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages = np.empty(0, dtype=np.int64)
    is_leaf = []
    for _ in range(most):
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        is_leaf.append(rank < len(leaves))
        both = both[rank]
        packages = both[0 : len(both) - len(both) % 2].reshape(-1, 2).sum(axis=1)
    lengths = np.zeros(len(leaves), dtype=np.int64)
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())  # leaves are taken in their order, so these are the n rarest
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        most = self.most = max(MAX_BITS, int(self.lengths.max(initial=0)))
        symbols = np.flatnonzero(self.lengths)
        symbols = symbols[np.lexsort((symbols, self.lengths[symbols]))]
        self.codes = np.zeros(len(lengths), dtype=np.uint32)
        spans = np.int64(1) << (most - self.lengths[symbols])
        firsts = np.cumsum(spans) - spans
        self.codes[symbols] = (firsts >> (most - self.lengths[symbols])).astype(np.uint32)
        self.table = np.ones(1 << most, dtype=np.uint32)  # 256 * id + bits
        self.table[: int(spans.sum())] = np.repeat(symbols << 8 | self.lengths[symbols], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Checkpoints and payload of a block."""
        if not len(ids):
            return b"", b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = ends - n
        value = self.codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
        word = at >> 5  # some code starts in every 32 bits, as none is longer than 25
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(value, firsts)  # codes share no bits
        packed = np.zeros(len(sums) + 1, dtype=np.uint32)
        packed[:-1] = sums >> np.uint64(32)
        packed[1:] |= sums.astype(np.uint32)
        return at[::STEP].astype("<u4").tobytes(), packed.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3]

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """Ids of blocks (n_tokens, checkpoints, payload)."""
        if not blocks:
            return []
        data = np.frombuffer(b"".join(b[2] for b in blocks) + bytes(STEP * self.most // 8 + 8), dtype=np.uint8).astype(np.uint32)
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        spare = np.uint32(32 - self.most)
        starts = np.cumsum([0] + [8 * len(b[2]) for b in blocks[:-1]])
        pos = np.concatenate([np.frombuffer(b[1], dtype="<u4").astype(np.int64) + s for b, s in zip(blocks, starts, strict=True)])
        out = np.empty((STEP, len(pos)), dtype=np.uint32)
        for k in range(STEP):
            out[k] = found = self.table[window[pos >> 3] << (pos & 7).astype(np.uint32) >> spare]
            pos += found & np.uint32(255)
        out >>= np.uint32(8)
        ids, row = [], 0
        for n, marks, _ in blocks:
            rows = len(marks) // 4
            ids.append(out[:, row : row + rows].T.ravel()[:n])
            row += rows
        return ids


# --- files --------------------------------------------------------------------------------------------------------

_BLOCKS = "part int, seq long, doc_ids binary, doc_lens binary, n_tokens long, checkpoints binary, payload binary"
_BLOCK_TYPES = {"part": pa.int32(), "seq": pa.int64(), "doc_ids": pa.binary(), "doc_lens": pa.binary(), "n_tokens": pa.int64(), "checkpoints": pa.binary(), "payload": pa.binary()}


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes one after another, and where each row's begin and end; without a copy."""
    column = column.cast(pa.binary())
    _, bounds, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, dtype=kind), np.zeros(len(column) + 1, dtype=np.int64)
    bounds = np.frombuffer(bounds, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(kind)
    return values, (bounds - bounds[0]) // values.itemsize


def _bytes_of(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A column of bytes: values from each of bounds to the next."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def write(tokens: DataFrame, path: str, width: int = 2, vocabulary: int = 1 << 16) -> None:
    """Write tokens (doc_id, n, ids) in ascending order of doc_id into the folder `path`."""
    kind = f"<u{width}"

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for part in parts:
            ids, _ = _joined(part.column(0), kind)
            for i in range(0, len(ids), 1 << 20):
                total += np.bincount(ids[i : i + (1 << 20)], minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]})

    counted = tokens.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row an id of the vocabulary
    counts = np.zeros(vocabulary, dtype=np.int64)
    counts[counted["id"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(counts)
    spark = tokens.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        part_id, seq, held = 0, 0, 0
        open_: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc_ids, numbers of ids and ids of the block that isn't full
        blocks: list[tuple] = []

        def close() -> None:
            nonlocal seq, held
            keys, n, ids = (np.concatenate(x) for x in zip(*open_, strict=True))
            marks, payload = book.encode(ids)
            blocks.append((part_id, seq, keys.astype("<i8").tobytes(), n.astype("<u4").tobytes(), len(ids), marks, payload))
            seq, held = seq + 1, 0
            open_.clear()

        def done() -> pa.RecordBatch:
            columns = zip(_BLOCK_TYPES.items(), zip(*blocks, strict=True), strict=True)
            found = pa.RecordBatch.from_arrays([pa.array(x, type=t) for (_, t), x in columns], names=list(_BLOCK_TYPES))
            blocks.clear()
            return found

        for part in parts:
            if not len(part):
                continue
            part_id = part.column(0)[0].as_py()
            keys = part.column(1).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            ids, upto = _joined(part.column(2), kind)
            begin = 0
            while begin < len(keys):
                end = min(len(keys), int(np.searchsorted(upto, upto[begin] + BLOCK_TOKENS - held)))
                end = max(end, begin + 1)
                open_.append((keys[begin:end], np.diff(upto[begin : end + 1]), ids[upto[begin] : upto[end]]))
                held += int(upto[end] - upto[begin])
                begin = end
                if held >= BLOCK_TOKENS:
                    close()
            open_[:] = [tuple(x.copy() for x in some) for some in open_]  # else they keep the whole batch
            if blocks:
                yield done()
        if open_:
            close()
            yield done()

    tie = F.xxhash64("ids")
    ordered = tokens.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    ordered.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "ids").mapInArrow(pack, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, nth, doc_id, n and ids (bytes of unsigned 32-bit integers) of every document in the files."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()[0], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(lengths)

    def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        for part in parts:
            begin, sizes = 0, part.column(4).to_numpy()
            while begin < len(part):
                upto = np.cumsum(sizes[begin : begin + 16])
                n = max(1, int(np.searchsorted(upto, 32 * BLOCK_TOKENS)))  # fewer blocks at once if they are large
                some = part.slice(begin, min(n, len(upto)))
                begin += len(some)
                ids = np.concatenate(book.decode([*zip(*(some.column(k).to_pylist() for k in (4, 5, 6)), strict=True)])).astype("<u4")
                keys, docs = _joined(some.column(2), "<i8")
                lens = _joined(some.column(3), "<u4")[0].astype(np.int64)
                docs = np.diff(docs)  # numbers of documents
                ends = np.concatenate(([0], np.cumsum(lens)))
                first = np.repeat(np.cumsum(docs) - docs, docs)
                columns = {
                    "part": np.repeat(some.column(0).to_numpy(), docs),
                    "seq": np.repeat(some.column(1).to_numpy(), docs),
                    "nth": np.arange(len(keys)) - first,
                    "doc_id": pa.array(keys, mask=keys == np.iinfo(np.int64).min),
                    "at": ends[:-1] - ends[first],
                    "n": lens,
                    "ids": _bytes_of(ids, ends),
                }
                yield pa.RecordBatch.from_pydict(columns)

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(unpack, "part int, seq long, nth long, doc_id long, at long, n long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs' ids and read the files back: doc_id, start, n_tokens and ids_crc32 of every row."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    e = encoder(tokenizer)
    write(stage(tokenize(docs, tokenizer), "token-ids"), path, e.width, 1 << 16 if e.width == 2 else e.tokenizer.get_vocab_size())
    crc = F.crc32("ids")
    found = read(spark, path).select("part", "seq", "doc_id", "at", "n", crc.alias("crc"))
    heads = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("part", "seq", "n_tokens")
    before, offsets = 0, []
    for r in heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row a written part
        offsets.append((r["part"], before))
        before += r["n"]
    parts = spark.createDataFrame(offsets, "part int, before long")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("inside", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(F.broadcast(parts), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("block_start"))
    joined = found.join(starts, ["part", "seq"])
    return joined.select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").cast("long").alias("ids_crc32"))
