"""Byte-pair encoding through a table of distinct words.

Texts are split at ASCII white space and between an ASCII letter or digit and a
punctuation mark, which no token of the vocabulary and no rule of its normaliser
crosses; A-Z are lower-cased, as the normaliser would do.

1. Tasks split the texts and number the words of every CHUNK_BYTES of text. A
   chunk becomes a row: its texts as numbers, and its distinct words, dealt to
   parts by a hash of the word. So a word travels once for each chunk, not once
   for each place.
2. A part's task has all requests for its words. Its table of distinct words is
   encoded, each word once over all texts, and joined to the requests.
3. The ids go back to the chunks and are joined to the texts by position.
4. Decoding takes ids alone and joins them to the vocabulary's pieces.

There are as many parts as the texts' bytes ask for, so a part's requests are
bounded by the distinct words of chunks; a word that all texts share has one
request from each chunk. The vocabulary's id-to-piece table is all that goes to
every task: it is the vocabulary file's, whatever the texts.

Nulls and empty texts have no tokens. Very long texts are split in pieces of a
megabyte, though a text and a word must fit a task. Repeated rows are encoded
alike, an empty table gives an empty one, nothing depends on an order of words
with equal counts, and other columns of the input pass by unused (those with the
names of the results are replaced).
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from lodestrata.llm.common import SLICE_BYTES, WHITE, binaries, cut, long_pieces, narrow, pack_binary, packed, parts_for, released, table, text_slices, unpack_binary, unpacked, with_fields

#: Bytes of text whose words are numbered together, and for which there is one part of the words.
CHUNK_BYTES, PART_BYTES = 16 << 20, 32 << 20

#: Between a letter or digit and one of these, a token always ends.
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_CHUNKS = "chunk long, texts binary, rows binary, parts binary, words array<struct<part int, words binary>>"
_REPLIES = "chunk long, part int, ids binary"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a run of texts, one after another, and the number of words in each text."""
    n = len(offsets) - 1
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(n, np.int64)
    if n == 1 and len(data) > 2 * SLICE_BYTES:
        found = [words_of(x, np.array([0, len(x)]))[0] for x in long_pieces(data)]
        return pa.concat_arrays(found), np.array([sum(map(len, found))])
    inside = WHITE[data] != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (_MARKS[data[1:]] & _ALNUM[data[:-1]])
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    first = np.flatnonzero(starts)
    # case stays where a special token might stand
    body = data[inside] if b"<|" in data.tobytes() else _LOWER[data[inside]]
    at = np.append(np.cumsum(inside)[first] - 1, len(body)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(body)])
    return words, np.bincount(np.searchsorted(offsets, first, "right") - 1, minlength=n)


class Vocabulary:
    """A tokenizer and its pieces, made once in each Python process."""

    _made: dict = {}

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        pieces = [self.tokenizer.id_to_token(i) for i in range(size)]
        #: The id-to-piece table, each piece with the blank that parts it from the next.
        self.pieces = pa.array([b"" if p is None else p.encode() + b" " for p in pieces], pa.large_binary())

    @classmethod
    def of(cls, source: str) -> Vocabulary:
        key = hashlib.sha256(source.encode()).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(source)
        return cls._made[key]

    def encode(self, words: pa.Array) -> pa.Array:
        """For each word its ids, as little-endian unsigned 32-bit integers."""
        out = []
        for at in range(0, len(words), 1 << 14):
            found = self.tokenizer.encode_batch([w.decode() for w in words.slice(at, 1 << 14).to_pylist()], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in found]
        return pa.array(out, pa.large_binary())

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of `counts` ids each, by a join of ids to pieces."""
        return [t[:-1] for t in _cut_up(self.pieces.take(pa.array(ids)), counts)]


def _cut_up(joined: pa.Array, counts: np.ndarray) -> list[bytes]:
    """The values of runs of `counts` entries, each run as one."""
    edges = np.append(0, np.cumsum(counts))
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][edges] if len(joined) else np.zeros(len(edges), np.int64)
    data = memoryview(joined.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


#: The normaliser and the split by which texts may be cut into words as `words_of` does.
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_source(path: str) -> str:
    """The vocabulary file's JSON, checked for what the split by words rests on."""
    source = Path(path).read_text()
    parsed = json.loads(source)
    if parsed["model"]["type"] != "BPE" or parsed["model"]["dropout"] or parsed["post_processor"] or parsed["decoder"]:
        raise ValueError("only plain BPE vocabularies without a decoder can be split by words")
    steps = [n["type"] for n in parsed["normalizer"]["normalizers"]]
    if steps != _NORMALISERS or parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _SPLIT} or not all(t["content"].startswith("<|") for t in parsed["added_tokens"]):
        raise ValueError("this vocabulary's rules aren't those by which texts are cut into words")
    return source


def _in_sevens(x: np.ndarray) -> np.ndarray:
    """Whole numbers in bytes of seven bits, lowest first; a set eighth bit says that more follow."""
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21) + (x >= 1 << 28)
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(x) else 0):
        own = np.flatnonzero(size > k)
        out[first[own] + k] = ((x[own] >> 7 * k) & 127) | (size[own] > k + 1) << 7
    return out


def _from_sevens(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max()) + 1 if len(last) else 0):
        own = np.flatnonzero(first + k <= last)
        out[own] |= (data[first[own] + k] & 127).astype(np.int64) << 7 * k
    return out


def _pack_ids(ids: pa.Array) -> bytes:
    """Binaries of 32-bit ids, byte by byte, which compresses well."""
    offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    whole = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 4)
    return packed(narrow(np.diff(offsets) // 4), *(whole[:, k] for k in range(4)))


def _unpack_ids(raw: bytes) -> pa.Array:
    lengths, *planes = unpacked(raw)
    return binaries(lengths.astype(np.int64) * 4, np.stack(planes, 1).ravel())


def numbered(docs: DataFrame, parts: int) -> DataFrame:
    """Chunks of docs, whose last column is the text: texts as numbers of words, and the words by part."""

    def chunk_row(number: int, rows: list, words: list) -> pa.RecordBatch:
        every = pa.concat_arrays(words).dictionary_encode()
        of, n = np.asarray(every.indices), len(every.dictionary)
        # numbers by falling count are small where they are many
        order = np.argsort(-np.bincount(of, minlength=n), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        distinct = every.dictionary.take(pa.array(order))
        part = np.array([xxhash.xxh3_64_intdigest(w) % parts for w in distinct.to_pylist()], np.int64)
        by_part = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[by_part], np.arange(parts + 1)) if parts < n else np.append(np.flatnonzero(np.diff(part[by_part], prepend=-1)), n)
        asked = [{"part": int(part[by_part[a]]), "words": pack_binary(distinct.take(pa.array(by_part[a:b])))} for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        sink = pa.BufferOutputStream()
        kept = pa.Table.from_batches(rows).combine_chunks()
        with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(kept)
        row = {"chunk": number, "texts": packed(_in_sevens(rank[of])), "rows": sink.getvalue().to_pybytes(), "parts": packed(narrow(part)), "words": asked}
        types = pa.schema([("chunk", pa.int64()), ("texts", pa.binary()), ("rows", pa.binary()), ("parts", pa.binary()), ("words", pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())])))])
        return pa.RecordBatch.from_pylist([row], schema=types)

    def split(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, 0
        rows, words = [], []
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                own, n = words_of(data, offsets)
                part = batch.slice(first, len(n))
                rows.append(pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=[*part.schema.names[:-1], "__n"]))
                words.append(own)
                held += len(data) + 64 * len(n)
                if held >= CHUNK_BYTES:
                    yield chunk_row(base + made, rows, words)
                    rows, words, held, made = [], [], 0, made + 1
        if rows:
            yield chunk_row(base + made, rows, words)
        released()

    return docs.mapInArrow(split, _CHUNKS)


def word_ids(requests: DataFrame, source: str) -> DataFrame:
    """(chunk, part, ids) for requests (chunk, part, words): the table of a part's distinct words, joined to each request."""

    def encoded(group: pa.Table) -> pa.Table:
        asked = [unpack_binary(x.as_py()) for x in group["words"]]
        every = pa.concat_arrays(asked).dictionary_encode()
        ids = Vocabulary.of(source).encode(every.dictionary)
        of, at, out = every.indices, 0, []
        for own in asked:
            out.append(_pack_ids(ids.take(of.slice(at, len(own)))))
            at += len(own)
        made = pa.table({"chunk": group["chunk"], "part": group["part"], "ids": pa.array(out, pa.binary())})
        released()
        return made

    return requests.groupBy("part").applyInArrow(encoded, _REPLIES)


def _through(docs: DataFrame, path: str, names: list[str], types: list, made, dropped: list[str]) -> DataFrame:
    """docs without the dropped columns, with those that made(ids of each text, vocabulary) gives."""
    source = tokenizer_source(path)
    kept = [c for c in docs.columns if c not in (*names, *dropped)]
    schema = with_fields(docs.schema, [*names, *dropped], *zip(names, types, strict=True))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(size, PART_BYTES)
    chunks = cut(numbered(docs.select(*kept, F.col("text").alias("__text")), parts))
    number = max(1, chunks.count())
    requests = chunks.select("chunk", F.explode("words").alias("w")).select("chunk", "w.part", "w.words").repartitionById(parts, "part")
    replies = word_ids(requests, source).repartition(number, "chunk")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left.slice(0, 1).to_pylist()[0]
        rows = pa.ipc.open_stream(chunk["rows"]).read_all()
        part, text = unpacked(chunk["parts"])[0], _from_sevens(unpacked(chunk["texts"])[0])
        found = sorted(zip(right["part"].to_pylist(), right["ids"], strict=True), key=lambda x: x[0])
        # words were asked for by part, and in the order of their numbers within one
        ids = pa.concat_arrays([_unpack_ids(x.as_py()) for _, x in found] or [pa.array([], pa.large_binary())])
        place = np.empty(len(part), np.int64)
        place[np.argsort(part, kind="stable")] = np.arange(len(part))
        own = _cut_up(ids.take(pa.array(place[text])), np.asarray(rows["__n"]))
        del text, ids
        vocabulary = Vocabulary.of(source)
        columns = made(own, vocabulary)
        out = rows.drop_columns(["__n"])
        for name, column in zip(names, columns, strict=True):
            out = out.append_column(name, column)
        released()
        return out

    return chunks.select("chunk", "texts", "rows", "parts").repartition(number, "chunk").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(joined, schema)


def _decoded(own: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Each text of ids, decoded; some texts at a time."""
    out, at = [], 0
    while at < len(own):
        end, size = at, 0
        while end < len(own) and size < SLICE_BYTES:
            size += len(own[end])
            end += 1
        ids = np.frombuffer(b"".join(own[at:end]), "<u4")
        out += vocabulary.decode(ids, np.array([len(x) // 4 for x in own[at:end]]))
        at = end
    return out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with one more column, token_ids (little-endian u32, binary)."""
    return _through(docs, path, ["token_ids"], [BinaryType()], lambda own, _: [pa.array(own, pa.binary())], [])


def decode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs (with token_ids) with one more column, decoded: the ids joined to the vocabulary's pieces. Null ids decode to an empty text."""
    source, kept = tokenizer_source(path), [c for c in docs.columns if c != "decoded"]

    def decode(batches):
        vocabulary = Vocabulary.of(source)
        for batch in batches:
            texts = _decoded([x or b"" for x in batch.column(kept.index("token_ids")).to_pylist()], vocabulary)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode() for t in texts], pa.string())], names=[*kept, "decoded"])

    return docs.select(*kept).mapInArrow(decode, with_fields(docs.schema, ["decoded"], ("decoded", StringType())))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (of the ids, decoded again) instead of the ids and the text."""

    def digest(own: list[bytes], vocabulary: Vocabulary):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) // 4 for x in own], pa.int64()), pa.array(list(map(sha, own)), pa.string()), pa.array(list(map(sha, _decoded(own, vocabulary))), pa.string())]

    return _through(docs, path, ["n_tokens", "ids_sha256", "decoded_sha256"], [LongType(), StringType(), StringType()], digest, ["text"])


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
