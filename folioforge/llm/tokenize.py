"""Encoding of texts with a public byte-level BPE tokenizer, as a streaming transducer.

A text is read in pieces of bounded size. A position is stable when no continuation can change the pieces of
text before it; what lies before the last stable position is split, merged and emitted, and only the tail is
carried on. Stability needs a lookahead that the pattern bounds: a piece that begins at white space followed by
a visible sign, or between signs of two kinds, never reaches back. Within one very long piece of a single kind
the merge list bounds the lookahead: see lookahead_bytes(); such a piece is merged in windows while it is read and
the tokens that end more than the bound before the window's end are emitted. A token boundary that stays is crossed by no
merge, so what follows it is merged as if it stood alone. Held are never more than a few CHUNKs of text.

Decoding is a state machine from ids to text that holds back at most three bytes of an unfinished character.

Defined cases: null and empty texts give the empty list; blank texts are encoded as they are; a special
token's string is ordinary text; repeated rows give repeated rows; lone surrogates cannot occur in columns;
texts of any length are encoded whole, in constant memory beside the result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.runtime import table

#: Folder of the public vocabularies; a parameter of every function that needs one.
VOCABULARIES = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Fixed value: the pattern that splits text for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 16
LONG_PIECE = 1 << 12

# Between a visible sign and a single white space before a letter or a number, nothing joins: the blank opens the next piece.
_STABLE = regex.compile(r"(?<=\S)(?=\s[\p{L}\p{N}])")
_PIECES = regex.compile(PATTERN)


def read_ranks(folder: str = VOCABULARIES, name: str = NAME) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def lookahead_bytes(ranks: dict[bytes, int]) -> int:
    """Bytes beyond a token's end that can still change it.

    In merge order a token boundary moves only if a merge of higher priority crosses it later; the chain of merges
    that a change sets off has falling priorities, and each is at most the longest token long. Chains as deep as
    the merge tree of the longest token suffice: depth times length.
    """
    longest = max(map(len, ranks))
    depth: dict[bytes, int] = {}
    for token, _ in sorted(ranks.items(), key=lambda x: (len(x[0]), x[1])):
        depth[token] = 0 if len(token) == 1 else 1 + min((max(depth[token[:i]], depth[token[i:]]) for i in range(1, len(token)) if token[:i] in depth and token[i:] in depth), default=0)
    return longest * (1 + max(depth.values()))


_RUNS = [(regex.compile(r" ?\p{L}+"), regex.compile(r"\p{L}+")), (regex.compile(r" ?\p{N}+"), regex.compile(r"\p{N}+")), (regex.compile(r" ?[^\s\p{L}\p{N}]+"), regex.compile(r"[^\s\p{L}\p{N}]+")), (regex.compile(r"\s+"), regex.compile(r"\s+"))]
_BLANKS = _RUNS[3][1]


class Transducer:
    """Text in, ids out. feed() gives the ids that have become stable, finish() the rest.

    tail is text not split yet; head holds the bytes of a piece that is still being read, run the pattern of its kind.
    """

    def __init__(self, ranks: dict[bytes, int], encoding: tiktoken.Encoding | None = None, lookahead: int | None = None) -> None:
        self.ranks = ranks
        self.encoding = encoding or tiktoken.Encoding("streamed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lookahead = lookahead
        self.tail, self.head, self.run = "", b"", None

    def feed(self, text: str) -> list[int]:
        self.tail += text
        out = self._read_on() if self.run else []
        cut = 0
        for m in _STABLE.finditer(self.tail, max(0, len(self.tail) - CHUNK // 2)):
            cut = m.start()
        if cut:
            out += self.encoding.encode_ordinary(self.tail[:cut])
            self.tail = self.tail[cut:]
        elif len(self.tail) > CHUNK:
            out += self._split()
        return out

    def _split(self) -> list[int]:
        """Pieces that no continuation changes; the last, if long, is opened and read on in windows."""
        pieces = _PIECES.findall(self.tail)
        ready, opened = (pieces[:-1], pieces[-1]) if len(pieces[-1]) > CHUNK // 2 else (pieces[:-3], "")
        out = [i for piece in ready for i in self._merge(piece.encode())]  # piece by piece: split anew, blanks at the end would join
        self.tail = self.tail[sum(map(len, ready)) :]
        if not opened:
            return out
        self.run = next(rest for whole, rest in _RUNS if whole.fullmatch(opened))
        kept = -1 if self.run is _BLANKS else len(opened)  # the last blank may belong to what follows
        self.head, self.tail = opened[:kept].encode(), opened[kept:]
        return out + self._drain(False)

    def _read_on(self) -> list[int]:
        """Take what continues the open piece from the tail."""
        m = self.run.match(self.tail)
        end = m.end() if m else 0
        if end == len(self.tail):
            kept = end - (self.run is _BLANKS)
            self.head, self.tail = self.head + self.tail[:kept].encode(), self.tail[kept:]
            return self._drain(False)
        end -= self.run is _BLANKS and end > 0
        self.head, self.tail = self.head + self.tail[:end].encode(), self.tail[end:]
        self.run = None
        return self._drain(True)

    def _drain(self, closed: bool) -> list[int]:
        """Tokens of the open piece that end more than the lookahead before what is read of it; all if it is closed."""
        self.lookahead = self.lookahead or lookahead_bytes(self.ranks)
        out: list[int] = []
        at, size = 0, LONG_PIECE + self.lookahead
        while len(self.head) - at > size:
            done = 0
            for i in self._merge(self.head[at : at + size]):
                width = len(self.encoding.decode_single_token_bytes(i))
                if done + width > LONG_PIECE:
                    break
                out.append(i)
                done += width
            at += done
        self.head = self.head[at:]
        if closed:
            out += self._merge(self.head)
            self.head = b""
        return out

    def _merge(self, data: bytes) -> list[int]:
        return [] if not data else [self.ranks[data]] if data in self.ranks else self.encoding._encode_single_piece(data)

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.run:
            m = self.run.match(self.tail)
            end = m.end() if m else 0
            end -= self.run is _BLANKS and 0 < end < len(self.tail)
            self.head, self.tail, self.run = self.head + self.tail[:end].encode(), self.tail[end:], None
            out = self._drain(True)
        ready, self.tail = self.tail, ""
        return out + self.encoding.encode_ordinary(ready)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= CHUNK:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for k in range(0, len(text), CHUNK):
            out.extend(self.feed(text[k : k + CHUNK]))
        return out + self.finish()


def decode_stream(ids: Iterator[int], ranks: dict[bytes, int]) -> Iterator[str]:
    """Text of ids as soon as its characters are whole."""
    back = {v: k for k, v in ranks.items()}
    decoder = codecs.getincrementaldecoder("utf-8")("strict")
    for i in ids:
        if text := decoder.decode(back[i]):
            yield text
    if text := decoder.decode(b"", True):
        yield text


def _encode_batches(ranks, count_only: bool):
    def run(batches):
        machine = None
        for batch in batches:
            machine = machine or Transducer(ranks.value)
            ids = [machine.encode(t) for t in batch.column(1).to_pylist()]
            second = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), second, *batch.columns[2:]], [batch.schema.field(0).name, "n_tokens" if count_only else "ids", *batch.schema.names[2:]])

    return run


def _shared_ranks(df: DataFrame, folder: str, name: str):
    """The merge list, read by the driver and broadcast; a vocabulary is a few MB whatever the texts."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(folder, name))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """key and ids of each row."""
    sent = df.select(F.col(key), F.col(text))
    return sent.mapInArrow(_encode_batches(_shared_ranks(df, folder, name), False), f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "source", folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """key, n_tokens and one kept column of each row."""
    sent = df.select(F.col(key), F.col(text), F.col(keep))
    types = {c: df.schema[c].dataType.simpleString() for c in (key, keep)}
    return sent.mapInArrow(_encode_batches(_shared_ranks(df, folder, name), True), f"{key} {types[key]}, n_tokens long, {keep} {types[keep]}")


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode(table(spark, directory, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
