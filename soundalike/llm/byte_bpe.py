"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges of one pre-token are taken in order of rank.  A queue keeps a bucket of positions per rank and a
two-level bitmap over ranks: find-first-set gives the next rank, and entries whose pair has changed since they
were queued are skipped.  The symbols are a doubly linked list in arrays, so a merge costs a few queue
operations whatever the length of the pre-token; there is no rescan, and a pre-token of megabytes is no
special case.  Equal ranks are taken from left to right, as in the greedy definition.

Short pre-tokens, which are most of a text, share one queue: those of a block of texts that are not yet known
are laid one after the other into one linked list, with no pairs across their borders, and a bucket then holds
positions of many pre-tokens that one step merges together.  Each pre-token still sees its own merges in order
of rank, because different pre-tokens do not touch.

Encoding is a pure function of one text: Spark partitions the rows and nothing is shuffled.  A worker keeps the
ids of short pre-tokens it has met in a table that is emptied when full.

Defined results: null texts are empty, and have no tokens.  Lone surrogates cannot occur in Spark strings.
Special tokens are ordinary text.  Any bytes decode, also those that are no UTF-8 (``decode_bytes``).
Repeated rows are encoded each; empty tables give no rows; extra columns are carried along unless they have
the name of an output column, which the output then takes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, need, per_process, query, table

#: Pre-tokens of up to so many characters are remembered; the table is emptied above so many of them.
REMEMBERED_CHARS = 48
REMEMBERED = 400_000
#: Texts are encoded in blocks of about so many characters.
BLOCK_CHARS = 2_000_000
#: Ids take so many bits in a pair's key; the lower bitmap has words of 2**8 bits.
ID_BITS = 24


class ByteBpe:
    """A vocabulary of byte strings with ranks, and the pattern that splits texts before merging."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        #: Rank of the pairs met so far, -1 for pairs that do not merge; emptied when full.
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}

    def _new_pair(self, key: int) -> int:
        tokens = self.tokens
        rank = self.ranks.get(tokens[key >> ID_BITS] + tokens[key & (1 << ID_BITS) - 1], -1)
        if len(self.pairs) >= 4 * REMEMBERED:
            self.pairs.clear()
        self.pairs[key] = rank
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pairs, new_pair = self.pairs, self._new_pair
        n = len(piece)
        single = self.single
        ids = [single[b] for b in piece]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # now[i]: what the pair that starts at i merges to; queued entries of another rank are stale.
        now = [-1] * n
        summary, words, buckets = 0, {}, {}
        queued = [(i, ids[i] << ID_BITS | ids[i + 1]) for i in range(n - 1)]
        current = -1
        rest: list[int] = []
        while True:
            for i, key in queued:
                rank = pairs.get(key)
                if rank is None:
                    rank = new_pair(key)
                now[i] = rank
                if rank < 0:
                    continue
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    words[word] = words.get(word, 0) | 1 << (rank & 255)
                    summary |= 1 << word
                if rank < current and rest:
                    # A smaller rank has come up: what is left of this bucket waits.
                    buckets[current] = rest
                    word = current >> 8
                    words[word] = words.get(word, 0) | 1 << (current & 255)
                    summary |= 1 << word
                    rest = []
            if not rest:
                if not summary:
                    break
                word = (summary & -summary).bit_length() - 1
                bits = words[word]
                current = word << 8 | (bits & -bits).bit_length() - 1
                bits &= bits - 1
                words[word] = bits
                if not bits:
                    summary &= summary - 1
                rest = buckets.pop(current)
                if len(rest) > 1:
                    rest.sort(reverse=True)
            queued = []
            i = rest.pop()
            if now[i] != current:
                continue
            j = right[i]
            ids[i], ids[j], now[i], now[j] = current, -1, -1, -1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                queued.append((i, current << ID_BITS | ids[after]))
            before = left[i]
            if before >= 0:
                queued.append((before, ids[before] << ID_BITS | current))
        return [x for x in ids if x >= 0]

    @cached_property
    def splits(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (left id, right id) of all pairs that merge, and their ranks."""
        keys, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << ID_BITS | b)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, "i8"))
        return np.array(keys, "i8")[order], np.array(ranks, "i8")[order]

    def _pair_ranks(self, left, right) -> np.ndarray:
        keys, ranks = self.splits
        wanted = np.left_shift(left, ID_BITS) | right
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens, by one queue over their common linked list."""
        lengths = np.fromiter(map(len, pieces), "i8", len(pieces))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        piece_of = np.repeat(np.arange(len(pieces)), lengths)
        ids = np.array(self.single, "i8")[np.frombuffer(b"".join(pieces), "u1")]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends - 1] = -1
        left[ends - lengths] = -1
        now = np.full(n, -1, "i8")
        inner = np.flatnonzero(right >= 0)
        now[inner] = self._pair_ranks(ids[inner], ids[inner + 1])
        alive = np.ones(n, bool)
        summary, words, buckets = 0, {}, {}
        fresh, fresh_ranks = inner, now[inner]
        while True:
            live = fresh_ranks >= 0
            fresh, fresh_ranks = fresh[live], fresh_ranks[live]
            if len(fresh):
                order = fresh_ranks.argsort(kind="stable")
                fresh, fresh_ranks = fresh[order], fresh_ranks[order]
                cuts = np.flatnonzero(fresh_ranks[1:] != fresh_ranks[:-1]) + 1
                edges = [0, *cuts.tolist(), len(fresh)]
                for rank, a, b in zip(fresh_ranks[edges[:-1]].tolist(), edges, edges[1:]):
                    if rank in buckets:
                        buckets[rank].append(fresh[a:b])
                    else:
                        buckets[rank] = [fresh[a:b]]
                        word = rank >> 8
                        words[word] = words.get(word, 0) | 1 << (rank & 255)
                        summary |= 1 << word
            if not summary:
                break
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bits &= bits - 1
            words[word] = bits
            if not bits:
                summary &= summary - 1
            parts = buckets.pop(rank)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = at[now[at] == rank]
            if len(at) > 1:
                # One merge per pre-token at a time, from the left; the others are queued again.
                at = np.unique(at)
                home = piece_of[at]
                again = np.flatnonzero(home[1:] == home[:-1]) + 1
                if len(again):
                    buckets[rank] = [at[again]]
                    words[word] = words[word] | 1 << (rank & 255)
                    summary |= 1 << word
                    at = np.delete(at, again)
            if not len(at):
                fresh = fresh_ranks = at
                continue
            gone = right[at]
            ids[at] = rank
            now[gone] = now[at] = -1
            alive[gone] = False
            after = right[gone]
            right[at] = after
            has = after >= 0
            head, tail = at[has], after[has]
            left[tail] = head
            before = left[at]
            before = before[before >= 0]
            fresh = np.concatenate((head, before))
            fresh_ranks = self._pair_ranks(
                np.concatenate((ids[head], ids[before])), np.concatenate((ids[tail], ids[right[before]])))
            now[fresh] = fresh_ranks
        data = ids[alive].astype("<u4").tobytes()
        stops = np.cumsum(np.add.reduceat(alive, ends - lengths, dtype="i8")) * 4
        return [data[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of short pre-tokens."""
        known, ranks, todo, names = self.known, self.ranks, [], []
        for piece in new:
            data = piece.encode("utf-8")
            whole = ranks.get(data)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            else:
                todo.append(data)
                names.append(piece)
        if todo:
            known.update(zip(names, self.merge_many(todo)))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, find = self.known, self.pattern.findall
        if len(known) > REMEMBERED:
            known.clear()
        split = [find(text) for text in texts]
        new = set().union(*split).difference(known)
        long = {p for p in new if len(p) > REMEMBERED_CHARS}
        self._learn(sorted(new - long))
        extra = {p: np.array(self.merge(p.encode("utf-8")), "<u4").tobytes() for p in long}
        if extra:
            return [b"".join([known.get(p) or extra[p] for p in pieces]) for pieces in split]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def vocabulary(path: str, pattern: str) -> ByteBpe:
    return per_process(f"bpe {path} {pattern}", lambda: ByteBpe(path, pattern))


def _columns(batch: pa.RecordBatch, without: set[str]) -> tuple[list, list[str]]:
    keep = [i for i, n in enumerate(batch.schema.names) if n not in without]
    return [batch.column(i) for i in keep], [batch.schema.names[i] for i in keep]


def blocks(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null as empty); a slice is one text or up to BLOCK_CHARS."""
    texts = batch.column(batch.schema.get_field_index(text_col))
    start, held, size = 0, [], 0
    for i, item in enumerate(texts):
        text = item.as_py() or ""
        if held and size + len(text) > BLOCK_CHARS:
            yield batch.slice(start, i - start), held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield batch.slice(start), held


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` as an array column."""
    need(docs, text_col)
    schema = docs.drop(ids_col).withColumn(ids_col, F.array().cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for part, texts in blocks(batch, text_col):
                arrays, names = _columns(part, {ids_col})
                ids = [np.frombuffer(x, "<u4").astype("i8") for x in bpe.encode_packed(texts)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(ids, pa.list_(pa.int64()))], names=[*names, ids_col])
    return docs.transform(bounded).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of its token ids; a null array gives no bytes."""
    need(docs, ids_col)
    schema = docs.drop(out_col).withColumn(out_col, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                arrays, names = _columns(part, {out_col})
                data = [bpe.decode_bytes(x.as_py() or ())
                        for x in part.column(part.schema.get_field_index(ids_col))]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(data, pa.binary())], names=[*names, out_col])
    return docs.transform(bounded).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text",
               carried: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: carried columns, n_tokens, ids_sha256, decoded_sha256, exact.

    The decoded bytes of a text stay in the task, and so do the ids unless ``with_ids`` adds them as ``ids``.
    """
    need(docs, text_col, *carried)
    docs = docs.select(*carried, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in carried)
    schema = f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for part, texts in blocks(batch, "__text"):
                rows, ids = [], bpe.encode_packed(texts)
                for text, packed in zip(texts, ids):
                    back = bpe.decode_bytes(np.frombuffer(packed, "<u4").tolist())
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                                 hashlib.sha256(back).hexdigest(), back == text.encode("utf-8")))
                n, digests, decoded, exact = zip(*rows)
                arrays = [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(digests, pa.string()),
                          pa.array(decoded, pa.string()), pa.array(exact, pa.bool_())]
                names = [*carried, "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return docs.transform(bounded).mapInArrow(run, schema)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def op3(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
