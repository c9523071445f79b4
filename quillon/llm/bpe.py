"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Texts are cut by the tokenizer's pattern.  The distinct pieces of a run of rows are encoded by one recursive query: the
pairs at all token positions join the merge table; then a piece is a row with its token ids and the ranks of its pairs,
its pair of least rank is contracted at its leftmost place, the two new pairs join the merge table, and the row comes
again until no pair is left.  Decoding joins token rows to the vocabulary and aggregates their bytes in order of position.

A piece of more than `SHORT` bytes is cut into segments, which are encoded as pieces are.  A run of tokens is what BPE
makes of its bytes if and only if that is so for every two neighbours: the first contraction across a border between
tokens would happen just so in the bytes of the two tokens alone.  So the two tokens at each seam are encoded together;
where that does not give the same two, the tokens around are encoded anew, twice as many each time, and the borders of
what was encoded are seams again.

Only distinct pieces that a worker does not remember reach DuckDB; a piece's ids never depend on its neighbours.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .words import BLOCK_BYTES, blocks

#: Pieces that a worker remembers; beyond them it forgets those that it met least, at least half.
REMEMBERED = 500_000
#: Bytes of a piece that is encoded in one go, and of the segments of a longer one.
SHORT, SEGMENT = 64, 32
#: Tokens on each side of a seam that are first encoded anew.
AROUND = 4
#: The sum of squared lengths of the pieces that one recursive query takes in, as it keeps a row for each contraction.
QUERY_SQUARES = 16 << 20
#: Tokens that are decoded or gathered at once.
RUN_TOKENS = 1 << 19
#: The rank of a pair that does not merge, and the token before the first and after the last.
NONE, EDGE = (1 << 31) - 1, 1 << 30

RANKS = "SELECT place, merged FROM pairs JOIN merges USING (lr)"

ENCODE = f"""
WITH RECURSIVE bpe(w, ids, ranks, best) AS (
    SELECT w, ids, ranks, best FROM fresh
    UNION ALL
    SELECT w, ids, ranks, list_min(ranks)
    FROM (
        SELECT w, flatten([ids[:p - 1], [best], ids[p + 2:]]) AS ids,
            flatten([ranks[:p - 2], [coalesce(a.merged, {NONE}), coalesce(b.merged, {NONE})], ranks[p + 2:]]) AS ranks
        FROM (
            SELECT w, ids, ranks, best, p, ids[p - 1]::BIGINT << 32 | best AS before, best::BIGINT << 32 | ids[p + 2] AS behind
            FROM (SELECT w, ids, ranks, best, list_position(ranks, best) AS p FROM bpe WHERE best < {NONE})
        )
        LEFT JOIN merges a ON a.lr = before
        LEFT JOIN merges b ON b.lr = behind
    )
)
SELECT w, ids FROM bpe WHERE best = {NONE} ORDER BY w
"""

#: For what must be encoded in one go although it is long (texts without end of one period): all places of a pair of least
#: rank are contracted in one round, left to right, unless a token that it makes takes part in a merge of lower rank.
ENCODE_LONG = """
WITH RECURSIVE bpe(w, ids) USING KEY (w) AS (
    SELECT w, ids FROM fresh
    UNION
    SELECT b.w,
        CASE WHEN (h.best >> 32) & 1 = 1
            THEN b.ids[:(h.best & 4294967295) - 1] || [(h.best >> 33)::INTEGER] || b.ids[(h.best & 4294967295) + 2:]
            ELSE string_split(trim(replace('<' || array_to_string(b.ids, '><') || '>',
                '<' || b.ids[h.best & 4294967295] || '><' || b.ids[(h.best & 4294967295) + 1] || '>',
                '<' || (h.best >> 33) || '>'), '<>'), '><')::INTEGER[] END
    FROM bpe b
    JOIN (
        SELECT w, min((merged::BIGINT << 33) | (alone << 32) | place) AS best
        FROM (SELECT w, (unnest(ids[:-2])::BIGINT << 32) | unnest(ids[2:]) AS lr, unnest(range(1, len(ids))) AS place FROM bpe WHERE len(ids) > 1) t
        JOIN merges USING (lr)
        GROUP BY w
    ) h USING (w)
)
SELECT w, ids FROM bpe ORDER BY w
"""

#: A token's bytes are characters of code points 0 to 255 here.
DECODE = "SELECT string_agg(bytes, '' ORDER BY place) FROM coded JOIN vocabulary USING (id)"


def read_ranks(path: str) -> bytes:
    """The rank file at path, as it is: a token in base64, a blank and its rank on each line."""
    with open(path, "rb") as f:
        return f.read()


def _offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _gathered(values: np.ndarray, offsets: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The values of the runs with these numbers, one run after the other."""
    size = offsets[runs + 1] - offsets[runs]
    where = np.repeat(offsets[runs] - _offsets(size)[:-1], size)
    where += np.arange(len(where))
    return values[where]


class Numbers(dict):
    """Pieces and their numbers; a piece that is new gets the next one and is listed in `new`."""

    def __init__(self, known: list[str] = ()):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Codec:
    """A vocabulary, its pattern, a DuckDB with its merge table, and the pieces met lately with their ids and bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary has all 256 single bytes")
        self.size = np.full(max(self.tokens) + 1, -1, np.int64)
        for rank, token in self.tokens.items():
            self.size[rank] = len(token)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        alone = {part for left, right, merged in merges for part in (left, right) if part > merged and len(self.tokens[part]) > 1}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        left, right, merged = (np.array([m[i] for m in merges], np.int64) for i in range(3))
        self._table("m", lr=left << 32 | right, merged=merged.astype(np.int32), alone=np.array([m in alone for m in merged.tolist()], np.int64))
        self.db.register("v", pa.table({"id": pa.array(list(self.tokens), pa.int32()), "bytes": [t.decode("latin-1") for t in self.tokens.values()]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocabulary AS SELECT * FROM v")
        self.known, self.met = Numbers(), np.zeros(0, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.bytes, self.bytes_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _table(self, name: str, **columns: np.ndarray) -> None:
        self.db.register(name, pa.table({k: pa.array(v) for k, v in columns.items()}))

    def _lists(self, name: str, offsets: np.ndarray, **columns: np.ndarray) -> None:
        """Register a table of the rows w and the list columns with these borders and values, and of `best`."""
        where = pa.array(offsets.astype(np.int32))
        lists = {k: pa.ListArray.from_arrays(where, pa.array(v)) for k, v in columns.items()}
        best = {"best": pa.array(np.minimum.reduceat(columns["ranks"], offsets[:-1]))} if "ranks" in columns else {}
        self.db.register(name, pa.table({"w": pa.array(range(len(offsets) - 1), pa.int32()), **lists, **best}))

    def _asked(self, query: str, words: int, edges: int) -> list[np.ndarray]:
        """The ids that an encoding query of `words` registered rows gives, less those at the edges."""
        found = self.db.sql(query).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("fresh")
        values, at = found.values.to_numpy(), found.offsets.to_numpy()
        if len(at) != words + 1:
            raise RuntimeError("a piece was lost in encoding")
        return [values[a + edges : b - edges] for a, b in zip(at, at[1:], strict=False)]

    def _short(self, words: list[bytes]) -> list[np.ndarray]:
        """The token ids of non-empty words, by one recursive query."""
        offsets = _offsets([len(x) + 2 for x in words])
        ids = self.single[np.frombuffer(b"\0" + b"\0\0".join(words) + b"\0", np.uint8)]
        ids[offsets[:-1]] = ids[offsets[1:] - 1] = EDGE
        self._table("pairs", place=np.arange(len(ids) - 1, dtype=np.int32), lr=ids[:-1].astype(np.int64) << 32 | ids[1:])
        found = self.db.sql(RANKS).to_arrow_table()
        self.db.unregister("pairs")
        ranks = np.full(len(ids), NONE, np.int32)
        ranks[found["place"].to_numpy()] = found["merged"].to_numpy()
        self._lists("fresh", offsets, ids=ids, ranks=ranks)
        return self._asked(ENCODE, len(words), 1)

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """What the merges make of each non-empty word, in one go."""
        out: list[np.ndarray] = [self.single[:0]] * len(words)
        short = [i for i, x in enumerate(words) if len(x) <= SHORT]
        at = 0
        while at < len(short):
            to, squares = at, 0
            while to < len(short) and squares < QUERY_SQUARES:
                squares += len(words[short[to]]) ** 2
                to += 1
            for i, ids in zip(short[at:to], self._short([words[i] for i in short[at:to]]), strict=True):
                out[i] = ids
            at = to
        for i, x in enumerate(words):
            if len(x) > SHORT:
                self._lists("fresh", np.array([0, len(x)]), ids=self.single[np.frombuffer(x, np.uint8)])
                out[i] = self._asked(ENCODE_LONG, 1, 0)[0]
        return out

    def _long(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of words by segments, and of what is around seams that do not hold."""
        parts = [[x[i : i + SEGMENT] for i in range(0, len(x), SEGMENT)] for x in words]
        coded = iter(self.merged([s for x in parts for s in x]))
        out: list[list[int]] = []
        seams: list[list[int]] = []
        for x in parts:
            ids: list[int] = []
            borders = []
            for _ in x:
                borders.append(len(ids))
                ids += next(coded).tolist()
            out.append(ids)
            seams.append(borders[1:])
        holds: dict[tuple[int, int], bool] = {}
        around = AROUND
        while any(seams):
            fresh = list({(x[b - 1], x[b]) for x, borders in zip(out, seams, strict=True) for b in borders} - holds.keys())
            for (l, r), ids in zip(fresh, self.merged([self.tokens[l] + self.tokens[r] for l, r in fresh]), strict=True):
                holds[l, r] = ids.tolist() == [l, r]
            redo: list[list[list[int]]] = []
            for x, borders in zip(out, seams, strict=True):
                mine: list[list[int]] = []
                for b in borders:
                    if not holds[x[b - 1], x[b]]:
                        lo, hi = max(b - around, 0), min(b + around, len(x))
                        if mine and lo <= mine[-1][1]:
                            mine[-1][1] = max(hi, mine[-1][1])
                        else:
                            mine.append([lo, hi])
                redo.append(mine)
            coded = iter(self.merged([b"".join(self.tokens[i] for i in x[lo:hi]) for x, mine in zip(out, redo, strict=True) for lo, hi in mine]))
            for k, mine in enumerate(redo):
                old, ids, borders, at = out[k], [], [], 0
                for lo, hi in mine:
                    ids += old[at:lo]
                    borders.append(len(ids))
                    ids += next(coded).tolist()
                    borders.append(len(ids))
                    at = hi
                if mine:
                    ids += old[at:]
                    out[k] = ids
                seams[k] = [b for b in borders if 0 < b < len(ids)]
            around *= 2
        return out

    def pieces_to_ids(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The token ids of each piece; a piece that is itself a token is that token."""
        out = [np.array([r] if (r := self.ranks.get(x)) is not None else [], np.int32) for x in pieces]
        for long, encode in ((False, self.merged), (True, self._long)):
            todo = [i for i, x in enumerate(pieces) if x and not len(out[i]) and (len(x) > SHORT) == long]
            for i, ids in zip(todo, encode([pieces[i] for i in todo]), strict=True):
                out[i] = np.asarray(ids, np.int32)
        return out

    def ids_to_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, by ordered aggregation over its token rows; an id that is no token raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for at in range(0, len(ids), RUN_TOKENS):
            part = ids[at : at + RUN_TOKENS].astype(np.int32)
            self._table("coded", place=np.arange(len(part), dtype=np.int32), id=part)
            out.append(self.db.sql(DECODE).fetchall()[0][0].encode("latin-1"))
            self.db.unregister("coded")
        return b"".join(out)

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's pieces."""
        pieces = self.pattern.findall(text) if len(text) <= BLOCK_BYTES else (m.group() for m in self.pattern.finditer(text))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64)

    def learn(self, used: np.ndarray) -> None:
        """Have the ids and the decoded bytes of all numbered pieces; count the use of the numbers."""
        fresh, self.known.new = self.known.new, []
        runs = self.pieces_to_ids([x.encode() for x in fresh])
        if runs:
            ids = np.concatenate(runs)
            data = np.frombuffer(self.ids_to_bytes(ids), np.uint8)
            size = np.array([len(x) for x in runs])
            long = np.add.reduceat(self.size[ids], _offsets(size)[:-1])
            self.ids, self.ids_at = np.concatenate([self.ids, ids]), np.append(self.ids_at, self.ids_at[-1] + np.cumsum(size))
            self.bytes, self.bytes_at = np.concatenate([self.bytes, data]), np.append(self.bytes_at, self.bytes_at[-1] + np.cumsum(long))
        met = np.bincount(used, minlength=len(self.known))
        met[: len(self.met)] += self.met
        self.met = met

    def forget(self) -> None:
        """Where more pieces than REMEMBERED are known, keep the ones met most often, at most half as many."""
        if len(self.known) <= REMEMBERED:
            return
        half = REMEMBERED // 2
        kept = np.flatnonzero(self.met > max(np.partition(self.met, -half)[-half], 1))
        for values, at in (("ids", "ids_at"), ("bytes", "bytes_at")):
            old, where = getattr(self, values), getattr(self, at)
            setattr(self, values, _gathered(old, where, kept))
            setattr(self, at, _offsets((where[1:] - where[:-1])[kept]))
        names = list(self.known)
        self.known, self.met = Numbers([names[i] for i in kept.tolist()]), self.met[kept] // 2


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(ranks, pattern)


def _coder(ranks, pattern: str, text: str, want_ids: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks.value, pattern)
        for batch, texts in blocks(batches, text):
            bpe.forget()
            cut = [bpe.numbers(texts.text(i).decode()) for i in range(batch.num_rows)]
            bpe.learn(np.concatenate(cut))
            n_tokens, ids_sha, bytes_sha, ids = [], [], [], []
            for numbers in cut:
                coded, decoded, count = hashlib.sha256(), hashlib.sha256(), 0
                kept = []
                for at in range(0, len(numbers), RUN_TOKENS):
                    part = _gathered(bpe.ids, bpe.ids_at, numbers[at : at + RUN_TOKENS]).astype("<u4", copy=False)
                    coded.update(part)
                    decoded.update(_gathered(bpe.bytes, bpe.bytes_at, numbers[at : at + RUN_TOKENS]))
                    count += len(part)
                    if want_ids:
                        kept.append(part.tobytes())
                n_tokens.append(count)
                ids_sha.append(coded.hexdigest())
                bytes_sha.append(decoded.hexdigest())
                ids.append(b"".join(kept))
            out = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            out.append(pa.array(n_tokens, pa.int64()))
            if want_ids:
                out.append(pa.array(ids, pa.binary()))
            out += [pa.array(ids_sha), pa.array(bytes_sha)]
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_tokens", *["ids"] * want_ids, "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Tokens of every whole text; a map over partitions, without a shuffle.

    ranks_path: a rank file, read once on the driver and broadcast (its size does not grow with the data).  keep: columns
    that are carried on; others are not read.  Returns keep, n_tokens, ids (little-endian unsigned 32-bit; only
    with_ids), ids_sha256 and decoded_sha256 of the bytes that the ids decode to.

    A null text counts as empty: no tokens, digests of no bytes.  Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [docs.schema[k] for k in keep] + [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids + [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    read = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    return read.mapInArrow(_coder(shared, pattern, "__text", with_ids, list(keep)), T.StructType(fields))


def decode(coded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes of binary id columns as encode() makes them: keep and `data`.  Null ids decode to no bytes; an id that
    the vocabulary lacks raises."""
    shared = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                runs = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in part.column(part.num_columns - 1).to_pylist()]
                ids = np.concatenate(runs)
                whole = bpe.ids_to_bytes(ids)
                cuts = _offsets(bpe.size[ids])[_offsets([len(x) for x in runs])]
                data = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(data, pa.binary())], [*keep, "data"])

    schema = T.StructType([coded.schema[k] for k in keep] + [T.StructField("data", T.BinaryType())])
    return coded.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)
