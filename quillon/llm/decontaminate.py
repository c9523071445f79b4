"""Benchmark decontamination with DataFrame and SQL functions only.

Words are maximal runs of letters and digits in lower case; shingles are runs of five words (of all words, for an item
of fewer).  A window is as many words as the item has, or those left before the text's end.  The similarity of a window
and an item is the weighted Jaccard similarity of their shingles, each weighted by how often it stands there.

Which windows are formed.  A window without a shingle of the item has similarity 0, and moving any other window right to
the first shingle it shares with the item neither loses a shared shingle nor adds weight.  So windows of n words are
formed where a shingle of some item of n words begins, and only those with enough words left to be similar: one filter
over the shingles of each text, against the benchmark's shingles as constants (or, where these are more than
`max_constants`, a shuffled join).  Texts are cut into overlapping parts of twice the size of an item before windows
are, so that a window copies no more than such a part.

How items are found for them.  Each window gets a 64-bit SimHash, counted in packed lanes.  An index holds the items'
SimHashes by size, number of block and bits of that block, of radius + 1 blocks; windows join it by all of theirs.  Of
any two SimHashes within `radius` bits some block agrees, so the join finds every item of the window's size within
the radius, and no other source names items for a window.  The exact similarity then decides.

A shingle that stands again counts as another one, hashed with how often it stood before, so the weighted similarity is
that of sets, and a shingle's repeats do not all vote for the same bits of a SimHash.  At similarity 0.8 the angle of
two such sets makes about 10 of 64 bits differ, with a deviation of 3, so the default radius of 22 is four deviations out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import written

SHINGLE = 5
BITS = 64
#: Parts that the rows of the index are dealt to where it is too large to be broadcast, so that no block is one task.
SALTS = 16
#: Lanes of a packed counter: 4 counters of 16 bits in a long, of which a window of up to NARROW shingles uses 15; for
#: more shingles 2 counters of 32 bits, of which 31 are used.
NARROW = 16_383
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), NOT_WORD), lambda w: w != "")


def _shingles(hashes: str, k: int) -> Column:
    """Hashes of all runs of k words, from word hashes; none where there are fewer words."""
    parts = ", ".join(f"get({hashes}, i + {j})" for j in range(k))
    return F.expr(f"if(size({hashes}) < {k}, array(), transform(sequence(0, greatest(size({hashes}) - {k}, 0)), i -> xxhash64({parts})))")


def _ranked(shingles: str) -> Column:
    """Distinct hashes: of a shingle's first occurrence, its own; of the ones after, of the shingle and their number."""
    # In order, equal ones are neighbours: powers of two lead back from each to the first, and nothing is bound twice.
    steps = "array(" + ", ".join(str(1 << b) for b in range(30, -1, -1)) + ")"
    before = f"i - aggregate({steps}, i, (at, step) -> if(at >= step AND get(t, at - step) = x, at - step, at))"
    again = f"transform(t, (x, i) -> if(i > 0 AND get(t, i - 1) = x, xxhash64(x, {before}), x))"
    ranked = f"get(transform(array(array_sort(s)), t -> {again}), 0)"
    return F.expr(f"get(transform(array({shingles}), s -> if(size(array_distinct(s)) = size(s), s, {ranked})), 0)")


def _folded(shingles: str, lane: int) -> str:
    """The SimHash by counters of so many bits."""
    mask = sum(1 << at for at in range(0, BITS, lane))
    top = lane - 2
    folds = []
    for shift in range(lane):
        total = f"aggregate({shingles}, 0L, (a, x) -> a + (shiftrightunsigned(x, {shift}) & {mask}L))"
        most = f"(size({shingles}) div 2)"
        # Adding 2**top - 1 - n/2 to a count sets the next bit of its lane if the count is above n/2; the sign stays clear.
        folds.append(f"shiftleft(shiftrightunsigned({total} + ({(1 << top) - 1} - {most}) * {mask}L, {top}) & {mask}L, {shift})")
    return " | ".join(folds)


def _simhash(shingles: str) -> Column:
    """Bit b is set where more than half of the shingles' hashes have it."""
    return F.expr(f"if(size({shingles}) <= {NARROW}, {_folded(shingles, 16)}, {_folded(shingles, 32)})")


def _cuts(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of radius + 1 blocks."""
    n = radius + 1
    edges = [b * BITS // n for b in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block(value: str, at: int, size: int) -> str:
    return f"shiftrightunsigned({value}, {at}) & {(1 << size) - 1}L"


def _blocks(value: str, cuts: list[tuple[int, int]]) -> Column:
    return F.expr("array(" + ", ".join(f"struct({b} AS block, {_block(value, a, s)} AS bits)" for b, (a, s) in enumerate(cuts)) + ")")


def _text_key(words: str) -> Column:
    return F.md5(F.array_join(words, " "))


def items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: the distinct item texts that have words, the groups of them, and the ids.

    Texts: __t (their digest), __w (words), __k (shingle length), __size (the least power of two not below __w), __s
    (shingles), __b (ranked shingles), __f (SimHash).  Groups: __u, __t, a group being all texts of an id, which is one
    where ids are unique; so equal items are compared once.  Ids: __item, __u."""
    cut = written(benchmark.select(F.col(item_id).alias("__item"), _words(text).alias("__words")).where(F.size("__words") > 0).withColumn("__t", _text_key("__words")))
    texts = cut.dropDuplicates(["__t"]).select("__t", F.size("__words").alias("__w"), F.least(F.size("__words"), F.lit(SHINGLE)).alias("__k"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))
    short = F.when(F.col("__k") == SHINGLE, _shingles("__h", SHINGLE))
    for k in range(1, SHINGLE):
        short = short.when(F.col("__k") == k, _shingles("__h", k))
    size = F.expr("shiftleft(1, length(bin(__w - 1)))")
    texts = written(texts.withColumn("__s", short).drop("__h").withColumn("__size", size))
    texts = written(texts.withColumn("__b", _ranked("__s")))
    texts = written(texts.withColumn("__f", _simhash("__b")))
    held = cut.select("__item", "__t").distinct()
    ids = held.groupBy("__item").agg(*(F.sum(F.xxhash64("__t", F.lit(k)).cast("decimal(38,0)")).alias(f"__u{k}") for k in range(2)))
    ids = written(ids.select("__item", F.concat_ws(" ", "__u0", "__u1").alias("__u")))
    groups = written(held.join(ids, held["__item"].eqNullSafe(ids["__item"])).select("__u", "__t").distinct())
    return texts, groups, ids


def index(texts: DataFrame, radius: int = 22) -> DataFrame:
    """__w, __block, __bits, __t, __f: every text by each of its radius + 1 blocks."""
    out = texts.select("__w", "__t", "__f", F.explode(_blocks("__f", _cuts(radius))).alias("__at"))
    return out.select("__w", F.col("__at.block").alias("__block"), F.col("__at.bits").alias("__bits"), "__t", "__f")


def near(windows: DataFrame, known: DataFrame, radius: int = 22, broadcast: bool = True) -> DataFrame:
    """Every pair of a window (__w, __g: its SimHash) and an item text of as many words, with their SimHashes within
    radius bits, once: all columns of windows and __t.  known: what index() makes."""
    cuts = _cuts(radius)
    asked = windows.select("*", F.explode(_blocks("__g", cuts)).alias("__at")).select("*", F.col("__at.block").alias("__block"), F.col("__at.bits").alias("__bits")).drop("__at")
    keys = ["__w", "__block", "__bits"]
    if broadcast:
        known = F.broadcast(known)
    else:
        keys.append("__salt")
        asked = asked.withColumn("__salt", F.pmod(F.xxhash64("__g", "__row"), F.lit(SALTS)))
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    # A pair meets once for each block that agrees; the first of them stands for all.
    first = "coalesce(" + ", ".join(f"if(({_block('(__f ^ __g)', a, s)}) = 0, {b}, NULL)" for b, (a, s) in enumerate(cuts)) + ")"
    met = asked.join(known, keys).where(F.expr(f"bit_count(__f ^ __g) <= {radius} AND __block = {first}"))
    return met.select(*windows.columns, "__t")


def _hit_parts(read: DataFrame, texts: DataFrame, wanted: DataFrame, keys: list | None) -> DataFrame:
    """__doc, __k, __size, __from (the part's place in the text), __part (its shingles, twice __size), __starts (places in
    its first half where a shingle of an item of this size begins).

    read: __doc, __h (word hashes).  keys: all rows of wanted (__k, __x, __size), or None where they are too many."""
    classes = sorted({(r["__k"], r["__size"]) for r in keys}) if keys is not None else sorted(tuple(r) for r in texts.select("__k", "__size").distinct().collect())
    lengths = sorted({k for k, _ in classes}) or [SHINGLE]
    if keys is not None:
        constants = {c: ",".join(f"{r['__x']}L" for r in keys if (r["__k"], r["__size"]) == c) for c in classes}
        all_of = {k: ",".join(v for (j, _), v in constants.items() if j == k) or "NULL" for k in lengths}
        cut = read.select("__doc", *(_shingles("__h", k).alias(f"__s{k}") for k in lengths))
        cut = cut.select("*", *(F.expr(f"filter(transform(__s{k}, (x, i) -> if(x IN ({all_of[k]}), i, -1)), i -> i >= 0)").alias(f"__at{k}") for k in lengths))
        parts = []
        for k, size in classes:
            mine = f"__at{k}" if sum(j == k for j, _ in classes) == 1 else f"filter(__at{k}, i -> get(__s{k}, i) IN ({constants[k, size]}))"
            parts.append(f"transform(array_distinct(transform({mine}, i -> cast(i div {size} AS int))), p -> struct({k} AS k, {size} AS size, p * {size} AS place, slice(__s{k}, p * {size} + 1, {2 * size}) AS part))")
        none = "slice(array(struct(5 AS k, 1 AS size, 0 AS place, array(0L) AS part)), 1, 0)"
        # The outer form, as the optimizer would evaluate the array of an inner one twice.
        cut = cut.select("__doc", F.explode_outer(F.expr(f"concat({', '.join([none, *parts])})")).alias("__p")).where("__p IS NOT NULL")
        cut = cut.select("__doc", F.col("__p.k").alias("__k"), F.col("__p.size").alias("__size"), F.col("__p.place").alias("__from"), F.col("__p.part").alias("__part"))
        starts = F.array().cast("array<int>")
        for k, size in classes:
            inside = F.expr(f"filter(transform(slice(__part, 1, {size}), (x, i) -> if(x IN ({constants[k, size]}), i, -1)), i -> i >= 0)")
            starts = F.when((F.col("__k") == k) & (F.col("__size") == size), inside).otherwise(starts)
        return cut.withColumn("__starts", starts)
    found = None
    for k in lengths:
        # Rows are known by their shingles, not by a number that a second computation could give to another row.
        some = read.select("__doc", _shingles("__h", k).alias("__s")).withColumn("__r1", F.xxhash64("__s")).withColumn("__r2", F.xxhash64(F.reverse("__s"), F.lit(1)))
        hit = some.select("__r1", "__r2", F.posexplode("__s").alias("__i", "__x")).join(wanted.where(F.col("__k") == k), "__x")
        hit = hit.groupBy("__r1", "__r2", "__k", "__size", F.expr("cast(__i div __size AS int) * __size").alias("__from")).agg(F.collect_set(F.expr("cast(__i % __size AS int)")).alias("__starts"))
        some = some.join(hit, ["__r1", "__r2"]).select("__doc", "__k", "__size", "__from", F.expr("slice(__s, __from + 1, 2 * __size)").alias("__part"), "__starts")
        found = some if found is None else found.unionByName(some)
    return found


def windows(docs: DataFrame, texts: DataFrame, doc_id: str, text: str, similarity: float, max_constants: int, broadcast_rows: int) -> DataFrame:
    """The windows to be asked about, written: __row (a number), __doc, __w, __start, __x (first shingle), __a (ranked
    shingles)."""
    wanted = texts.select("__k", "__size", F.explode("__s").alias("__x")).distinct()
    keys = wanted.limit(max_constants + 1).collect()
    read = docs.select(F.col(doc_id).alias("__doc"), F.transform(_words(text), lambda w: F.xxhash64(w)).alias("__h"))
    parts = _hit_parts(read, texts, wanted, keys if len(keys) <= max_constants else None)
    sizes = texts.select("__k", "__size", "__w", F.explode("__s").alias("__x")).distinct()
    if sizes.limit(broadcast_rows + 1).count() <= broadcast_rows:
        sizes = F.broadcast(sizes)
    begun = parts.select("*", F.explode_outer("__starts").alias("__i")).where("__i IS NOT NULL").withColumn("__x", F.expr("get(__part, __i)"))
    # A window of fewer than similarity * n shingles cannot match an item of n.
    long = F.expr(f"size(__part) - __i >= {similarity}D * (__w - __k + 1) - 1e-9D")
    begun = begun.join(sizes, ["__k", "__size", "__x"]).where(long)
    begun = begun.select("__doc", "__w", (F.col("__from") + F.col("__i")).alias("__start"), "__x", _ranked("slice(__part, __i + 1, __w - __k + 1)").alias("__a"))
    return written(begun.withColumn("__row", F.monotonically_increasing_id()))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = 22, max_constants: int = 200_000, broadcast_rows: int = 100_000) -> DataFrame:
    """Pairs of a document and a benchmark item that a window of it matches: doc_id, item_id, similarity (the highest of
    its windows), n_windows (matching windows that start at a shared shingle), first_word (the first one's start, from
    0).  Documents without a match have no row.

    Null and empty texts match nothing.  Rows that repeat a doc_id are one document with the best of their windows; rows
    without id are taken together under a null id.  Equal items with different ids are each reported, though compared
    once.  Items are compared whole at any size.  An empty benchmark gives an empty result.  What is broadcast is
    counted first: up to broadcast_rows rows of numbers; beyond that the joins are shuffled.
    """
    texts, groups, ids = items(benchmark, item_id, item_text)
    made = windows(docs, texts, doc_id, text, similarity, max_constants, broadcast_rows)
    size = texts.agg(F.count("*").alias("n"), F.sum(F.size("__b")).alias("shingles")).first()
    few = size["n"] * (radius + 1) <= broadcast_rows
    asked = made.select("__row", "__w", _simhash("__a").alias("__g"))
    # An outer form again: the SimHash is evaluated once, and what follows refers to its value.
    asked = asked.select("__row", "__w", F.explode_outer(F.array("__g")).alias("__g"))
    pairs = near(asked, index(texts, radius), radius, few).select("__row", "__t")
    bodies = texts.select("__t", "__b")
    if few and (size["shingles"] or 0) <= 10 * broadcast_rows:
        bodies = F.broadcast(bodies)
    both = made.join(pairs, "__row").join(bodies, "__t").where(F.array_contains("__b", F.col("__x"))).withColumn("__shared", F.size(F.array_intersect("__a", "__b")))
    exact = both.select("__doc", "__t", "__start", (F.col("__shared") / (F.size("__a") + F.size("__b") - F.col("__shared"))).alias("__sim")).where(F.col("__sim") >= similarity)
    best = exact.join(groups, "__t").groupBy("__doc", "__u").agg(F.max("__sim").alias("similarity"), F.countDistinct("__start").alias("n_windows"), F.min("__start").alias("first_word"))
    return best.join(ids, "__u").drop("__u").select(F.col("__doc").alias(doc_id), F.col("__item").alias(item_id), "similarity", "n_windows", "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without those that match an item, all columns; a document without id stays unless one such matches."""
    found = matches(docs, benchmark, doc_id, **options).select(F.col(doc_id).alias("__leaked")).distinct()
    return docs.join(found, docs[doc_id].eqNullSafe(F.col("__leaked")), "left_anti")
