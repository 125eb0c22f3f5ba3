"""BPE encoding and decoding through a distinct-word table.

Words are maximal runs of non-white-space; neither the normaliser nor the
split pattern of the vocabulary joins anything across white space, so a text's
ids are the concatenation of its words' ids. The method therefore is:

1. split words in Spark and count them over the whole table;
2. encode each of the most frequent distinct words once, in a distributed job,
   into a *word table* of at most ``hot_words`` rows (its size is bounded by
   ``hot_words`` times ``WORD_LIMIT`` characters, so it may be broadcast);
3. join ids back by position: each document's words are looked up in order.
   Words beyond the bounded table go into a table of the task that meets them,
   which also encodes each of its distinct words once and is emptied at
   ``task_words`` entries;
4. decode with an id-to-piece join (``decode``), again by position.

A global table of *all* words grows with the corpus and cannot be broadcast;
joining it by shuffle would move every text or every position once more.

Defined results: null and empty texts give no ids and an empty decoded text;
repeated rows each give a row; other columns of the input are ignored unless
named in ``keep``. An empty table gives an empty table. Text of any length is
encoded whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.llm.base import map_batches, small_batches, strings, written

#: Longer words are never kept in a table (they are encoded where they occur).
WORD_LIMIT = 64
#: str.split() also cuts at these four, which are not white space in Unicode.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words of these characters need no normalisation beyond lower case.
_PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")


def split_words(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stays, other bytes follow from 256 on."""
    stays = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in stays]
    return {chr(b): b for b in stays} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of single words as little-endian unsigned 32-bit bytes.

    Plain Latin words take their ids from the vocabulary's merge ranks, with
    byte 0xFF (which UTF-8 never has) standing for the word end; everything
    else goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.core = None
        spec = json.loads(self.library.to_str())
        model, alphabet = spec["model"], _byte_alphabet()
        if model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges"):
            ranks = {}
            for piece, i in model["vocab"].items():
                end = piece.endswith("</w>")
                ranks[bytes(alphabet[c] for c in (piece[:-4] if end else piece)) + b"\xff" * end] = i
            if all(bytes([b]) in ranks for b in range(255)):
                ranks.setdefault(b"\xff", max(ranks.values()) + 1)
                self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, word: str) -> bytes:
        if self.core is not None and _PLAIN.fullmatch(word) and "<|" not in word:
            piece = self.core.encode_single_piece
            ids: list[int] = []
            for part in _PARTS.findall(word.lower()):
                ids += piece(part.encode() + b"\xff")
        else:
            ids = self.library.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


class WordTable(dict):
    """word -> id bytes; fills itself, and starts again from ``base`` at ``limit`` entries."""

    def __init__(self, encoder: WordEncoder, limit: int, base: dict[str, bytes] | None = None):
        super().__init__()
        self.encoder, self.limit, self.base = encoder, limit, base or {}

    def __missing__(self, word: str) -> bytes:
        ids = self.base.get(word)
        if ids is None:
            ids = self.encoder(word)
        if len(word) <= WORD_LIMIT:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split_words(text)))


def word_counts(docs: DataFrame, text: str = "text", flush: int = 200_000) -> DataFrame:
    """(word, n) over every text. Each task counts first, so a frequent word costs one row a task."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for value in strings(batch, text):
                seen.update(x for x in split_words(value) if len(x) <= WORD_LIMIT)
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str, text: str = "text", hot_words: int = 131_072) -> DataFrame:
    """(word, n, ids): at most ``hot_words`` of the most frequent distinct words, each encoded once.

    Frequencies are counted in steps of a sixteenth of an octave, and the
    words of whole steps are taken from the top: no task sorts or gathers words.
    """
    counted = written(word_counts(docs, text), "words").withColumn("step", F.floor(F.log2("n") * 16))
    room, least = hot_words, None
    for r in sorted(counted.groupBy("step").count().collect(), key=lambda r: -r.step):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    hot = counted.where(F.col("step") >= F.lit(least if least is not None else 1 << 20)).select("word", "n")

    def make():
        encoder = WordEncoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([encoder(w) for w in batch.column("word").to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], ["word", "n", "ids"])

        return step

    return map_batches(hot.repartition(docs.sparkSession.sparkContext.defaultParallelism), make, "word string, n long, ids binary")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", hot_words: int = 131_072, task_words: int = 300_000) -> DataFrame:
    """(key, ids array<int>) for every row of ``docs``."""
    words = {r.word: bytes(r.ids) for r in word_table(docs, path, text, hot_words).select("word", "ids").collect()}
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        table = WordTable(WordEncoder(path), task_words, shipped.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            blobs = [table.encode(x) for x in strings(batch, text)]
            offsets = np.zeros(len(blobs) + 1, np.int32)
            np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(blobs), "<u4").view("<i4"))
            return pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])

        return step

    return map_batches(docs.select(key, text), make, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")


def id_pieces(path: str) -> list[str | None]:
    """The id-to-piece table, by id; its size is that of the vocabulary."""
    from tokenizers import Tokenizer

    pieces = {i: p for p, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}
    return [pieces.get(i) for i in range(max(pieces, default=-1) + 1)]


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of an ids column: every id is joined to its piece, in order.

    This vocabulary names no decoder, for which the library's text is the
    pieces with one blank between them; ids without a piece are left out.
    """
    if json.loads(open(path, encoding="utf-8").read()).get("decoder") is not None:
        raise ValueError("only vocabularies without a decoder are supported")
    schema = StructType([*encoded.schema.fields, StructField(out, StringType())])

    def make():
        pieces = np.array(id_pieces(path), dtype=object)
        whole = all(x is not None for x in pieces)

        def one(part: np.ndarray) -> str:
            if whole and (not len(part) or int(part.max()) < len(pieces)):
                return " ".join(pieces[part])
            return " ".join(pieces[i] for i in part if i < len(pieces) and pieces[i] is not None)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(ids)
            flat, at = column.flatten().to_numpy(), 0
            texts = []
            for n in column.value_lengths().fill_null(0).to_pylist():
                texts.append(one(flat[at : at + n]))
                at += n
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

        return step

    return map_batches(encoded, make, schema)
