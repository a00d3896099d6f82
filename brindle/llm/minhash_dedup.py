"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification.

A shingle of weight ``w`` (its count in the text) arrives as a Poisson process
of rate ``w``; each arrival picks one of ``m`` components, and a component keeps
the shingle that arrives there first.  An element is dropped as soon as its
next arrival is later than the latest component (early termination).  Two texts
agree in a component with the probability Jaccard similarity of their weighted
shingles.  Components are grouped in bands; texts that share a band are
candidates, and candidates are verified on all their shingles: first with one
text of each bucket, in a few rounds, so that whole groups of copies become one
class at a cost in proportion to the texts; then, in buckets that still hold
several classes, all texts of different classes with each other.  Links inside
a class that other links make already are not made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import as_bytes, chunks, cut, forget, mix, record, release, schemas, slim, table
from brindle.llm._windows import ladder, window_names, word_lanes
from brindle.llm.components import components
from brindle.llm.repeats import largest_power

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: Rounds that make classes few before all that is still apart in a bucket is compared.
ROUNDS = 3
#: Texts that are compared with one leader in one task (on average).
FOLLOWERS = 512
#: Texts that ask, and texts asked, in one task of the exact pass (on average).
ASKING, ASKED = 512, 2_048


def shingle_names(values: np.ndarray, size: int) -> np.ndarray:
    """Names of a text's shingles from its words' values; a text of fewer than ``size`` words is one shingle."""
    size = min(size, len(values))
    if not size:
        return values
    k = largest_power(size)
    return window_names(ladder(values, (k,))[0], k, size)


def shingles(values: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle names of word-value arrays: name, text, count; sorted by text, name."""
    names = [shingle_names(v, size) for v in values]
    h = np.concatenate([np.zeros(0, np.uint64), *names])
    d = np.repeat(np.arange(len(names)), [len(x) for x in names])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return h[first], d[first], np.diff(np.append(first, len(h)))


def signatures(h: np.ndarray, d: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures: the winning shingle of each of ``m`` components for ``n`` texts."""
    best = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    t = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        x = mix(h ^ mix(np.array([turn], np.uint64)))
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        at = d * m + (mix(x) % np.uint64(m)).astype(np.int64)
        win = np.flatnonzero(t < best[at])
        win = win[np.argsort(-t[win], kind="stable")]  # of several, the first arrival is put last and stays
        best[at[win]] = t[win]
        winner[at[win]] = h[win]
        stay = t <= best.reshape(n, m).max(axis=1)[d]
        h, d, weight, t = h[stay], d[stay], weight[stay], t[stay]
    return winner.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets, each ``(sorted elements, weights)``."""
    if (a[1] == 1).all() and (b[1] == 1).all():
        both = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return both / max(len(a[0]) + len(b[0]) - both, 1)
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")
    below = np.concatenate([[0.0], np.cumsum(x)])[upto]
    above = y.sum() - np.concatenate([[0.0], np.cumsum(y)])[upto]
    both = (x > 0) & (y > 0)
    return float((1.0 / (above[both] / y[both] + below[both] / x[both])).sum())


def weighted_sets(texts: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and counts of each text."""
    h, d, count = shingles([x[0] for x in word_lanes(texts)], size)
    edges = np.searchsorted(d, np.arange(len(texts) + 1)).tolist()
    return [(h[a:b], count[a:b].astype(float)) for a, b in zip(edges, edges[1:], strict=False)]


def _sketch(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        for first, last in chunks(batch, "text"):
            part = batch.slice(first, last - first)
            texts = part.column(2).to_pylist()
            lanes = word_lanes(texts)
            h, d, count = shingles([x[0] for x in lanes], size)
            sig = signatures(h, d, count.astype(float), len(texts), m)
            key = np.broadcast_to(seeds, (len(texts), bands)).copy()
            for r in range(rows):
                key = mix(key ^ sig[:, r::rows])
            # Texts of the same words have one digest.
            digests = [xxhash.xxh3_128_digest(np.ascontiguousarray(x.T)) for x in lanes]
            d1 = [int.from_bytes(x[:8], "little", signed=True) for x in digests]
            d2 = [int.from_bytes(x[8:], "little", signed=True) for x in digests]
            band = [key[i].view(np.int64) if x.shape[1] else None for i, x in enumerate(lanes)]
            yield record(schema, [*part.columns, d1, d2, pa.array(band, pa.list_(pa.int64()))])


def _follow(batches: Iterator[pa.RecordBatch], size: int, threshold: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts (role 1) sorted behind their leader (role 0): whether each is like it."""
    lead, own = None, None
    for batch in batches:
        for first, last in chunks(batch, "text"):
            part = batch.slice(first, last - first)
            leads, roles, tids = (part.column(i).to_pylist() for i in (0, 1, 2))
            tested: list[tuple[int, int, bool]] = []
            for to, role, tid, x in zip(leads, roles, tids, weighted_sets(part.column(3).to_pylist(), size), strict=True):
                if not role:
                    lead, own = to, x
                    continue
                if to != lead:
                    raise ValueError("a leader's text is missing")
                tested.append((tid, to, probability_jaccard(x, own) >= threshold))
            yield record(schema, list(zip(*tested, strict=True)) if tested else [[], [], []])


def block_links(asking: list[tuple], asked: list[tuple], big: int, bucket: int, threshold: float, late: list[bool] | None = None, forest: bool = False) -> list[tuple[int, int]]:
    """Links between the classes of two lists of a bucket's texts: ``(tid, root, buckets, (elements, counts))``.

    A similarity of ``threshold`` needs as much common mass of the normalised
    weights.  So with elements in one order, rarest first, the first common one
    is where both texts still have that mass ahead; only texts that meet at
    such an element are compared.  A pair is left to the smallest bucket it
    shares; of texts outside the class ``big`` the smaller one asks (one that is
    ``late`` asks all).  Once a text is linked to a class, that class's other
    texts are passed over.  With ``forest``, linked classes are one class for all
    texts that ask later: the links are fewer than the classes, and join the same.
    """
    every = [*asking, *asked]
    size = np.array([len(x[3][0]) for x in every])
    edges = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(every)), size)
    _, place, often = np.unique(np.concatenate([x[3][0] for x in every]), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    mass = np.concatenate([x[3][1] / x[3][1].sum() for x in every])
    order = np.lexsort((rank[place], owner))
    ids, mass = rank[place][order], mass[order]
    done = np.concatenate([[0.0], np.cumsum(mass)])
    ahead = done[edges[1:]][owner] - done[:-1] >= threshold - 1e-6
    n = len(asking)
    post = np.flatnonzero(ahead & (owner >= n))
    post = post[np.argsort(ids[post], kind="stable")]
    post_ids, post_owner = ids[post], owner[post]
    tid, root = (np.array([x[i] for x in every], np.int64) for i in (0, 1))
    late = np.zeros(n, bool) if late is None else np.array(late, bool)
    names, of = np.unique(root, return_inverse=True)
    joined = np.arange(len(names))
    plain = np.array([bool((x[3][1] == 1).all()) for x in every])
    shared = np.full((len(every), max(len(x[2]) for x in every)), bucket, np.int64)
    for i, x in enumerate(every):
        shared[i, : len(x[2])] = x[2]
    mark = np.zeros(len(often), bool)
    links = []

    def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())

    for a in range(n):
        own = ids[edges[a] : edges[a + 1]]
        early = own[ahead[edges[a] : edges[a + 1]]]
        low = np.searchsorted(post_ids, early)
        hit = np.unique(post_owner[ranges(low, np.searchsorted(post_ids, early, "right") - low)])
        hit = hit[(joined[of[hit]] != joined[of[a]]) & ((root[hit] == big) | late[a] | (tid[hit] > tid[a]))]
        less = shared[a][shared[a] < bucket]
        hit = hit[~np.isin(shared[hit], less).any(axis=1)]
        if plain[a]:
            hit = hit[~plain[hit] | (np.minimum(size[hit], size[a]) >= (threshold - 1e-6) * np.maximum(size[hit], size[a]))]
        mark[own] = True
        most = 64
        while len(hit):
            now, hit = hit[:most], hit[most:]
            most = 512
            common = np.add.reduceat(mark[ids[ranges(edges[now], size[now])]].astype(np.int64), np.cumsum(size[now]) - size[now])
            like = common / (size[a] + size[now] - common) >= threshold
            for i in np.flatnonzero(~(plain[now] & plain[a])).tolist():
                like[i] = probability_jaccard(every[a][3], every[now[i]][3]) >= threshold
            found, first = np.unique(joined[of[now[like]]], return_index=True)
            links += [(int(tid[a]), int(tid[b])) for b in now[like][first]]
            if forest:
                joined[np.isin(joined, found)] = joined[of[a]]
                found = joined[of[a]]
            hit = hit[~np.isin(joined[of[hit]], found)]
        mark[own] = False
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Classes of near-duplicate documents; one row per input row.

    Columns: ``key``; ``class_id``, the smallest key of the class; ``kept``,
    true for one row of each class; ``text_hash``, xxhash64 of the text (a null
    text is empty).

    Texts are linked if the probability Jaccard similarity of their word
    shingles (for texts without repeated shingles: the Jaccard similarity) is
    ``threshold`` or more; classes are the links' components.  Texts of equal
    words are one text from the start.  In each of ``rounds`` every text is
    compared with one leader of a bucket in which it meets another class; then,
    in each bucket that still holds several classes, every pair of texts of
    different classes is decided (see :func:`block_links`), so no pair that
    shares a bucket is passed over unless it is of one class already.  Large
    buckets are decided in steps, with classes joined between them: first all
    texts with one part of the bucket, then the rest with parts twice as many.

    Null, empty and wordless texts are like no other text: each row is a class
    of its own.  Rows with a null key may belong to any class; repeated rows
    are one text.  An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(plain).alias("text_hash"), as_bytes(f"`{text}`").alias("text"))
    s1, a1 = schemas(source.schema.fields, "d1 long, d2 long, bands array<long>")
    sketch = cut(source.mapInArrow(slim(lambda it: _sketch(it, size, bands, rows, a1)), s1).withColumn("rid", F.monotonically_increasing_id()), "sketch")
    texts = cut(sketch.filter("bands is not null").groupBy("d1", "d2").agg(F.min("rid").alias("tid"), F.min("doc").alias("first")), "texts")
    banded = cut(sketch.select("rid", "bands").join(texts.select("tid"), F.col("rid") == F.col("tid"), "left_semi").select(F.col("rid").alias("tid"), F.explode("bands").alias("h")), "bands")
    sizes = banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    shared = cut(banded.join(sizes, "h"), "shared")
    # One plan at any size: a merge join, so that what is shuffled stays in proportion.
    cand = cut(sketch.select(F.col("rid").alias("tid"), "text").join(shared.select("tid").distinct().hint("merge"), "tid", "left_semi"), "candidates")
    forget(banded)
    s2, a2 = schemas([], "a long, b long, like boolean")
    s3, a3 = schemas([], "a long, b long")
    empty = spark.createDataFrame([], s3)

    def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
        """``h, tid, root`` of the buckets that hold several classes."""
        if roots is None:
            return members.select("h", "tid", F.col("tid").alias("root"))
        now = members.join(roots, members["tid"] == roots["node"], "left").select("h", "tid", F.coalesce("root", "tid").alias("root"))
        mixed = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h")
        return now.join(mixed, "h", "left_semi")

    def followed(members: DataFrame, turn: int) -> DataFrame:
        """Each text compared with the leader of one bucket where it meets another class."""
        order = F.xxhash64(F.lit(turn), "root")
        leaders = members.groupBy("h").agg(F.min(F.struct(order.alias("p"), F.col("tid").alias("lead"), F.col("root").alias("class"))).alias("l"))
        asks = members.join(leaders, "h").filter(F.col("root") != F.col("l.class")).groupBy("tid").agg(F.min(F.struct("l.p", "l.lead")).alias("l")).select("tid", F.col("l.lead").alias("lead"))
        asks = cut(asks, "asks")
        parts = asks.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts"))
        member = asks.join(parts, "lead").select("tid", "lead", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
        leader = parts.select(F.col("lead").alias("tid"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
        sent = member.unionByName(leader).hint("merge").join(cand, "tid").select("lead", "role", "tid", "text", "part")
        sent = sent.repartition("lead", "part").sortWithinPartitions("lead", "part", "role")
        out = cut(sent.select("lead", "role", "tid", "text").mapInArrow(slim(lambda it: _follow(it, size, threshold, a2)), s2), "followed")
        forget(asks)
        return out

    def dealt(now: DataFrame) -> DataFrame:
        """Each bucket's largest class and numbers of parts, and each text's part among the asking and the asked."""
        counted = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("m"))
        parts = counted.select("h", F.col("top.root").alias("big"), F.ceil((F.col("m") - F.col("top.c")) / ASKING).cast("int").alias("pa"), F.ceil(F.col("m") / ASKED).cast("int").alias("pb"))
        own_a, own_b = (F.pmod(F.xxhash64(F.lit(x), "tid"), F.col(x)).cast("int") for x in ("pa", "pb"))
        return cut(now.join(parts, "h").select("h", "tid", "root", "big", "pa", "pb", own_a.alias("ia"), own_b.alias("ib")), "apart")

    def apart(mixed: DataFrame, low: int, high: int) -> DataFrame:
        """Links between different classes of one bucket, with every pair of such texts decided whose first part is ``low`` to ``high``.

        Texts outside a bucket's largest class ask all its texts.  Parts of the
        asking meet parts of the asked, so no task gets a bucket of any size;
        with few texts asking, each text is sent about once for a bucket.
        A bucket's members, and so its parts of the asked, stay the same in all
        steps.  Texts of later parts ask those of this step; these ask the
        largest class's texts of later parts themselves, as nobody there asks.
        """
        of = mixed.groupBy("tid").agg(F.collect_list(F.struct("h", "root", "big", "pa", "pb", "ia", "ib")).alias("l"), F.max("pb").alias("most")).filter(F.col("most") > low).drop("most")
        sent = cand.join(of.hint("merge"), "tid").select("tid", "text", F.col("l.h").alias("hs"), F.explode(F.filter("l", lambda x: (x["pb"] > low) & (x["ib"] >= low))).alias("l"))
        sent = sent.withColumn("end", F.least(F.lit(high), "l.pb")).withColumn("late", F.col("l.ib") >= high)
        # Parts of this step's asking alone: a share of all the asking.
        sent = sent.withColumn("few", F.expr("cast(ceil(l.pa * (end - {0}) / (l.pb - {0})) as int)".format(low)))
        place = F.expr(f"""concat(
            if(not late or l.root = l.big, transform(sequence(0, if(late, few, l.pa) - 1), i -> struct(false AS asks, i AS i, l.ib AS j)), array()),
            if(l.root <> l.big, transform(sequence({low}, end - 1), j -> struct(true AS asks, l.ia AS i, j AS j)), array()),
            if(l.root <> l.big and not late and end < l.pb, transform(sequence(end, l.pb - 1), j -> struct(true AS asks, l.ia % few AS i, j AS j)), array()))""")
        sent = sent.select("tid", "text", "hs", "late", F.col("l.h").alias("h"), F.col("l.root").alias("root"), F.col("l.big").alias("big"), F.explode(place).alias("p")).select("h", "p.i", "p.j", "p.asks", "late", "tid", "root", "big", "hs", "text")

        def decide(rows: pa.Table) -> pa.Table:
            sets = weighted_sets(rows["text"].to_pylist(), size)
            sides: tuple[list, list] = [], []
            late = []
            for asks, after, tid, root, hs, own in zip(*(rows[c].to_pylist() for c in ("asks", "late", "tid", "root", "hs")), sets, strict=True):
                sides[asks].append((tid, root, hs, own))
                if asks:
                    late.append(after)
            found = block_links(sides[1], sides[0], rows["big"][0].as_py(), rows["h"][0].as_py(), threshold, late, forest=True) if all(sides) else []
            release()
            return pa.Table.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=a3)

        return cut(sent.groupBy("h", "i", "j").applyInArrow(decide, s3), "verified")

    roots, links, tested = None, empty, []
    for turn in range(rounds):
        now = cut(rooted(shared, roots), "mixed")
        if turn:
            forget(roots)
        if not now.limit(1).count():
            forget(now)
            break
        tested.append(followed(now, turn))
        forget(now)
        links = links.union(tested[-1].filter("like").select("a", "b"))
        roots = components(links)
    else:
        now = rooted(shared, roots)
        # A bucket of two texts that were compared already is decided.
        pairs = now.groupBy("h").agg(F.min("tid").alias("x"), F.max("tid").alias("y"), F.count(F.lit(1)).alias("m")).filter("m = 2")
        known = empty
        for one in tested:
            known = known.union(one.select(F.least("a", "b"), F.greatest("a", "b")))
        known = pairs.join(known, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left_semi").select("h")
        now = cut(now.join(known, "h", "left_anti"), "mixed")
        low, high = 0, 1
        while True:
            mixed = dealt(now)
            forget(now, roots)
            parts = mixed.agg(F.max("pb")).first()[0] or 0
            if parts > low:
                links = links.union(apart(mixed, low, high))
            forget(mixed)
            low, high = high, 2 * high
            if parts <= low:
                break
            roots = components(links)
            now = cut(rooted(shared, roots), "mixed")
    forget(cand, shared)
    roots = components(links)
    named = texts.join(roots, texts["tid"] == roots["node"], "left").select("d1", "d2", "tid", "first", F.coalesce("root", "tid").alias("root"))
    classes = named.groupBy("root").agg(F.min("first").alias("class_id"), F.min(F.struct(F.col("first").isNull().alias("x"), "first", "tid")).alias("keeper"))
    whole = named.join(classes, "root").select("d1", "d2", "class_id", (F.col("keeper.tid") == F.col("tid")).alias("head"), "first", "tid")
    has = F.col("bands").isNotNull()
    lone = sketch.filter(~has).select(F.col("doc").alias(key), F.col("doc").alias("class_id"), F.lit(True).alias("kept"), "text_hash")
    # Of the rows of a class's first text, the one with the smallest key is kept, and of those the first row.
    heads = sketch.filter(has).select("d1", "d2", "doc", "rid").join(whole.filter("head").select("d1", "d2"), ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "rid")).alias("r")).select(F.col("r.rid").alias("head_rid"))
    rest = sketch.filter(has).select("doc", "text_hash", "d1", "d2", "rid").join(whole.select("d1", "d2", "class_id"), ["d1", "d2"])
    rest = rest.join(heads, rest["rid"] == heads["head_rid"], "left").select(F.col("doc").alias(key), "class_id", F.col("head_rid").isNotNull().alias("kept"), "text_hash")
    out = cut(rest.unionByName(lone), "classes")
    forget(sketch, texts, roots, *tested)
    return out


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
ORACLE: dict[str, str] = {}
