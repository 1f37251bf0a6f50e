"""N-gram Jaccard join (6): rare-first prefix filtering, then one check of each pair.

A document is its set of distinct word 5-grams (words lower-cased A-Z; fewer than five
words: the whole sequence as one), as 64-bit hashes. Two documents link when the sets'
Jaccard similarity is at least `percent` / 100, compared in integers.

1. One pass over the texts gives each document's set size and class (the hash of its
   set), and a sketch of how often shingles occur: 2**21 counters whatever the input,
   8 MB, so it may be broadcast. Documents with equal sets are one class from here on.
2. Shingles are ordered rare first by that sketch, ties by hash; any fixed order is right,
   a rare-first one is fast. A class posts the first n - ceil(p n) + 1 of its shingles.
3. Links within a big family of near copies would be as many as the square of its size,
   so pairs are made in turn. A star first: of each posting list, the member with the fewest
   rarer shingles is the hub, and each class is checked against the hub it meets
   most often. Then, only for posting lists that still hold several components, all pairs of members
   from different components. So no pair within a component found before is made, and none across
   components is left out: components are exact.
4. Pairs pass the length filter, the positional filter (shared prefix shingles plus all
   that can follow them must reach the needed overlap), and the suffix filter (what
   follows, dealt into 16 hash classes, can share the smaller count of each class at most).
   A pair that is left is checked once on the whole sets: pairs of a turn are kept, and later turns leave them out.
5. Every link lies within a component, so the links of each class are counted there: its
   classes are dealt by hash into blocks of bounded count and size, and each two blocks of a component
   are held against each other on whole sets, each pair of classes once. What is returned is counts, not pairs.

What a token is told of its list (members, hub, components) is aggregated before the shuffle and joined to
the list again, so that a token in a third of all prefixes is a skewed join, which Spark splits, and no window.
What a later turn starts from is written to the shared folder, small tables in few files; a table that only the same turn
reads twice is persisted on the executors' disks, where a lost part is computed again.

A list is only paired with itself across components. Defined results: null or empty text, or text of white space, has an empty set,
links with nothing and is its own component; rows with equal doc_id are classed by their
texts, each row is returned; null doc_id takes part and is returned, but never names a component unless it
has no other member; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, byte_strings, chunks, drop_held, drop_written, files_for, held, held_now, materialise, named, private, ragged, release, small_batches, text_of, written
from .components import connected_components
from .words import LOWER, WordHashes, shingle_set

SKETCH_BITS = 21
BLOCK = 1 << 16
SUFFIX_CLASSES = 16
BROADCAST_ROWS = 500_000  # of two numbers at most: some 30 MB as a hash table


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sets(batches, size: int):
    """The rows and shingle sets of a partition, a chunk at a time."""
    hashes = WordHashes()
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_BYTES):
            texts = byte_strings(part.column("text"))
            yield part, [shingle_set(hashes.of(t.translate(LOWER).split()), size) for t in texts]


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (doc_id, text_hash, n, cls), and for each task its counters in blocks (block, counts)."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["doc_id", "text_hash", "n", "cls", "block", "counts"]
        for part, sets in _sets(batches, size):
            for s in sets:
                counts[_buckets(s)] += 1 if len(s) else 0
            own = [
                pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *own], names)
        for block in range(len(counts) // BLOCK):
            own = counts[block * BLOCK : (block + 1) * BLOCK]
            if own.any():
                small = np.minimum(own, 65535).astype("<u1" if own.max() < 256 else "<u2")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, None, block, small.tobytes()], kinds, strict=True)], names)

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, cls long, block int, counts binary")


def _sketch(survey: DataFrame) -> np.ndarray:
    """The counters of all tasks together, on a scale of 64 steps for each doubling."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for chunk in table["counts"].chunks:
            for x in chunk:
                total += np.frombuffer(x.as_buffer(), "<u1" if len(x.as_buffer()) == BLOCK else "<u2")
        step = np.rint(64 * np.log2(1.0 + total)).astype("<u2")
        return pa.table({"block": table["block"][:1], "steps": pa.array([step.tobytes()], pa.binary())})

    rows = survey.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, steps binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for block, steps in rows:
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(steps, "<u2")
    return out


def _prefixes(docs: DataFrame, sketch, size: int, percent: int) -> DataFrame:
    """Per document: its prefix, rare first; the place of its last shingle; counts by hash class of what follows and of all."""

    def run(batches):
        steps = sketch.value
        seen: set[int] = set()
        for part, sets in _sets(batches, size):
            rows = []
            for i, s in zip(part.column("doc_id").to_pylist(), sets, strict=True):
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                rank = steps[_buckets(s)]
                order = np.argsort(rank, kind="stable")
                p = prefix_length(len(s), percent)
                last = order[p - 1]
                after = np.bincount((s[order[p:]] & (SUFFIX_CLASSES - 1)), minlength=SUFFIX_CLASSES)
                whole = np.bincount((s & (SUFFIX_CLASSES - 1)), minlength=SUFFIX_CLASSES)
                rows.append((i, c, len(s), s[order[:p]], int(rank[last]), int(s[last]), after, whole))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["rep", "cls", "n", "prefix", "last_rank", "last", "after", "whole"]
                )

    return docs.mapInArrow(run, "rep long, cls long, n long, prefix array<long>, last_rank int, last long, after array<int>, whole array<int>")


_MARK_BITS = 23


def _slot(column: str):
    return F.shiftrightunsigned(F.xxhash64(column), 64 - _MARK_BITS)


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each `rep`: 1 MB whatever the input. A bit too many costs time only, as a join follows."""
    slot = _slot("rep")
    words = ids.select(F.shiftright(slot, 5).alias("word"), F.pow(F.lit(2.0), slot % 32).cast("long").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (_MARK_BITS - 5), "<u4")
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype("<u4")
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _small(rows: DataFrame) -> DataFrame:
    """rows of one or two numbers, broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _whole_sets(docs: DataFrame, classes: DataFrame, of: DataFrame, size: int) -> DataFrame:
    """cls, shingles of the classes in `of`, each once, made from the texts again; sets of all documents are never kept.

    Only texts of these classes' documents reach Python where the ids are few enough to broadcast; else a bit for each id's hash sorts out the rest."""
    ids = held(classes.select("cls", "rep").join(of, "cls").select("rep"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    few = ids.count() <= BROADCAST_ROWS
    if few:
        rows = rows.join(F.broadcast(ids.select(F.xxhash64("rep").alias("key")).distinct()), "key", "left_semi")
    marks = None if few else docs.sparkSession.sparkContext.broadcast(_marks(ids))

    def fetch(batches):
        seen = set()
        wanted = batches if marks is None else (b.filter(pa.array(marks.value[b.column("slot").to_numpy(zero_copy_only=False)])) for b in batches)
        for _, sets in _sets(wanted, size):
            keep = []
            for s in sets:
                if len(s) and (c := _class_of(s)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    keep.append((c, s.tobytes()))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.int64()), pa.array([x[1] for x in keep], pa.binary())], ["cls", "shingles"])

    found = rows.select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(fetch, "cls long, shingles binary")
    return found.join(of, "cls", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy(F.lit(0)))).filter("nth = 1").drop("nth")


def _could_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs that pass the suffix filter."""
    light = classes.select("cls", "n", "prefix", "last_rank", "last", "after", "whole")
    of_class = lambda k: light.select(*(F.col(c).alias(f"{c}_{k}") for c in light.columns))
    rows = of_class("a").join(_small(pairs), F.col("a") == F.col("cls_a")).join(of_class("b"), F.col("b") == F.col("cls_b"))
    first = F.expr("struct(last_rank_a, last_a) <= struct(last_rank_b, last_b)")
    can = lambda x, y: F.least(
        F.expr(f"n_{x} - size(prefix_{x})"),
        F.expr(f"aggregate(zip_with(after_{x}, whole_{y}, (u, v) -> least(u, v)), 0, (s, u) -> s + u)")
    )
    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    return rows.filter(shared + F.when(first, can("a", "b")).otherwise(can("b", "a")) >= F.expr(_need("n_a", "n_b", percent))).select("a", "b")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b: classes) that link: the suffix filter, then whole sets, each pair once."""
    pairs = held(_could_link(pairs, classes, percent))
    of = held(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    total = classes.join(of, "cls").agg(F.sum("n")).first()[0] or 0
    sets = materialise(_whole_sets(docs, classes, of, size), "sets", files_for(total, 8_000_000))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("one")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("shingles").alias("other")), "b"
    )

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(byte_strings(batch.column("one")), byte_strings(batch.column("other")), strict=True):
                keep.append(_links(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "one", "other").mapInArrow(check, "a long, b long")


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact check of two whole sets."""
    shared = len(x) + len(y) - len(np.unique(np.r_[x, y]))
    return (100 + percent) * shared >= percent * (len(x) + len(y))


def _sizes_fit(one: str, other: str, percent: int):
    return F.expr(f"100 * least({one}, {other}) >= {percent} * greatest({one}, {other})")


def _need(one: str, other: str, percent: int) -> str:
    return f"ceil({percent} * ({one} + {other}) / {100 + percent})"


def _place_fits(percent: int):
    """For the first shingle that two prefixes share: itself and what follows in both must reach the overlap.

    A pair that links has such a row at its first shared shingle, so a pair without any is none."""
    return F.expr(f"least(n - pos, hub_n - hub_pos) >= {_need('n', 'hub_n', percent)}")


def _lists(classes: DataFrame) -> DataFrame:
    """The posting lists of more than one member: token, cls, n, pos, and own, hub: numbers by which the member with the least place is told."""
    posted = classes.select("cls", "n", F.posexplode("prefix").alias("pos", "token"))
    own = F.shiftleft(F.least("pos", F.lit((1 << 20) - 1)).cast("long"), 43) + F.shiftrightunsigned(F.xxhash64("cls"), 21)
    of_token = posted.groupBy("token").agg(F.count("*").alias("members"), F.min(own).alias("hub")).filter("members > 1").drop("members")
    return posted.join(of_token.hint("shuffle_hash"), "token").withColumn("own", own)


def _star(lists: DataFrame, percent: int) -> DataFrame:
    """For each class the hub it meets most often in the posting lists."""
    hubs = lists.filter("own = hub").select("token", F.col("cls").alias("hub_cls"), F.col("pos").alias("hub_pos"), F.col("n").alias("hub_n"))
    rows = lists.join(hubs.hint("shuffle_hash"), "token").filter("hub_cls <> cls").filter(_sizes_fit("n", "hub_n", percent)).filter(_place_fits(percent))
    met = rows.groupBy("cls", "hub_cls").agg(F.count("*").alias("met"))
    best = met.groupBy("cls").agg(F.max(F.struct("met", "hub_cls")).alias("best"))
    return best.select(F.least("cls", "best.hub_cls").alias("a"), F.greatest("cls", "best.hub_cls").alias("b")).distinct()


def _open_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The posting lists with more than one component in them, with each member's component."""
    named = lists.join(_small(comps), lists["cls"] == comps["node"], "left").select("token", "cls", "n", "pos", F.coalesce("comp", "cls").alias("comp"))
    several = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return named.join(several.hint("shuffle_hash"), "token", "left_semi")


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes of different components that shares a prefix shingle and passes the length and place filters.

    Components are paired first, by the most that any of their members in the list could share, then the members."""
    of = lists.groupBy("token", "comp").agg(F.max(F.col("n") - F.col("pos")).alias("room"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    side = lambda k: of.select("token", F.col("comp").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("room", "lo", "hi")))
    could = F.expr(f"least(room_x, room_y) >= {_need('lo_x', 'lo_y', percent)} and 100 * hi_x >= {percent} * lo_y and 100 * hi_y >= {percent} * lo_x")
    two = side("x").join(side("y"), "token").filter(F.col("x") < F.col("y")).filter(could).select("token", "x", "y", "room_y", "lo_y")
    left = lists.select("token", F.col("comp").alias("x"), F.col("cls").alias("a"), "n", "pos")
    right = lists.select("token", F.col("comp").alias("y"), F.col("cls").alias("b"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"))
    fits = F.expr(f"least(n - pos, room_y) >= {_need('n', 'lo_y', percent)}")
    met = left.join(two, ["token", "x"]).filter(fits).select("token", "y", "a", "n", "pos").join(right, ["token", "y"]).filter(_sizes_fit("n", "hub_n", percent)).filter(_place_fits(percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


LINK_BLOCK, LINK_BYTES = 1024, 4 << 20
_DENSE_COLUMNS, _SPARSE_PAIRS = 2048, 1 << 22


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `one` shares with each of `other`. Shingles that many sets hold are counted by a product of matrices, rare ones pair by pair."""
    out = np.zeros(len(one) * len(other), np.int64)
    kinds, which = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    cut = sum(map(len, one))
    left, right = which[:cut], which[cut:]
    of_left, of_right = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, other))
    n_left, n_right = (np.bincount(x, minlength=len(kinds)) for x in (left, right))
    dense = 64 * n_left * n_right > len(out)
    place = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), _DENSE_COLUMNS):
        both = []
        for x, of, n in ((left, of_left, len(one)), (right, of_right, len(other))):
            own = dense[x] & (place[x] >= at) & (place[x] < at + _DENSE_COLUMNS)
            m = np.zeros((n, _DENSE_COLUMNS), np.float32)
            m[of[own], place[x[own]] - at] = 1
            both.append(m)
        out += np.rint(both[0] @ both[1].T).astype(np.int64).ravel()
    by_kind = of_right[np.argsort(right, kind="stable")]
    starts = np.cumsum(n_right) - n_right
    rare = np.flatnonzero(~dense[left] & (n_right[left] > 0))
    part = np.cumsum(n_right[left[rare]]) // _SPARSE_PAIRS
    for own in np.split(rare, np.flatnonzero(np.diff(part)) + 1):
        counts = n_right[left[own]]
        pairs = np.repeat(of_left[own] * len(other), counts) + ragged(by_kind, starts[left[own]], counts)
        out += np.bincount(pairs, minlength=len(out))
    return out.reshape(len(one), len(other))


def _count_links(docs: DataFrame, classes: DataFrame, comps: DataFrame, size: int, percent: int) -> DataFrame:
    """cls, class_links: how many other classes each class links with, of all that exist.

    Links lie within components. A component is dealt by hash into blocks of some LINK_BLOCK classes
    and LINK_BYTES; each pair of its blocks is one unit of work, and small components share one by hash."""
    sizes = comps.join(classes.select(F.col("cls").alias("node"), "n"), "node").groupBy("comp").agg(F.count("*").alias("members"), F.sum(8 * F.col("n")).alias("bytes"))
    blocks = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("members") / LINK_BLOCK), F.ceil(F.col("bytes") / LINK_BYTES)).cast("int"))
    blocks = held(blocks)
    total = blocks.filter("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    shares = max(1, total // LINK_BYTES)
    named = comps.join(blocks.select("comp", "blocks"), "comp").select(F.col("node").alias("cls"), "comp", "blocks")
    named = held(named.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    whole = _whole_sets(docs, classes, named.select("cls"), size).join(named, "cls")
    dealt = whole.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    share = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(shares))).otherwise(F.col("comp"))
    units = dealt.select(
        share.alias("unit"), F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "with")).alias("lo"),
        F.greatest("block", "with").alias("hi"), "comp", "block", "cls", "shingles"
    )

    def count(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["block"].to_numpy(), table["comp"].to_numpy()))
        comp, block, cls = (table[c].to_numpy()[order] for c in ("comp", "block", "cls"))
        sets = [np.frombuffer(x, np.int64) for x in table["shingles"].cast(pa.binary()).take(pa.array(order)).to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        found = np.zeros(len(sets), np.int64)
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        cuts = np.r_[0, np.flatnonzero(np.diff(comp)) + 1, len(sets)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            two = 0 <= lo < hi
            mid = a + int(np.searchsorted(block[a:b], hi))
            one, other = (slice(a, mid), slice(mid, b)) if two else (slice(a, b), slice(a, b))
            if two and mid in (a, b):
                continue  # one of the blocks is empty
            linked = (100 + percent) * _shared(sets[one], sets[other]) >= percent * (n[one, None] + n[None, other])
            if two:
                found[other] = linked.sum(0)
            else:
                np.fill_diagonal(linked, False)
            found[one] = linked.sum(1)
        return pa.table({"cls": pa.array(cls, pa.int64()), "links": pa.array(found, pa.int64())})

    return units.groupBy("unit", "lo", "hi").applyInArrow(count, "cls long, links long").groupBy("cls").agg(F.sum("links").alias("class_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """A row per document: doc_id, n_shingles, class_id, class_links (how many other classes its class links with; null if count_links is False), component_id (smallest doc_id of its component), text_hash (xxhash64 of the text), first_hash (text_hash of the first row of its component by doc_id, nulls last, then text_hash; null without words).

    One table of sizes and classes stays persisted for the result; spark.catalog.clearCache() lets it go."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    small_batches(docs.sparkSession)
    before, held_before = written(), held_now()
    survey = held(_survey(docs, size))
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(survey))
    first = Window.partitionBy("cls").orderBy("rep")
    classes = materialise(_prefixes(docs, sketch, size, percent).withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth"), "classes")
    lists = materialise(_lists(classes), "lists")
    few = files_for(classes.count())
    star = materialise(_star(lists, percent), "pairs", few)
    edges, comps = connected_components(_verified(docs, classes, star, size, percent), few)
    drop_held([*held_before, survey])
    left = held(_open_lists(lists, comps))
    across = materialise(_across(left, percent).join(star, ["a", "b"], "left_anti"), "pairs", few)
    drop_held([*held_before, survey])
    release(lists)
    if not across.isEmpty():
        _, comps = connected_components(_verified(docs, classes, across, size, percent), few, edges)
    count = _count_links(docs, classes, comps, size, percent) if count_links else None
    members = survey.filter("block is null").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "cls")
    per_class = members.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
    linked = held(per_class.join(_small(comps), per_class["cls"] == comps["node"]).select("cls", "comp", "least"))
    firsts = materialise(linked.groupBy("comp").agg(F.min("least").alias("first")), "firsts", few)
    of_linked = linked.join(firsts, "comp").select("cls", "first")
    by_class = per_class.join(of_linked, "cls", "left").select("cls", F.coalesce("first", "least").alias("first")).select(
        "cls", F.col("first.doc_id").alias("component"), F.col("first.text_hash").alias("first_hash")
    )
    if count_links:
        by_class = by_class.join(count, "cls", "left")
    by_class = materialise(by_class, "named", few)
    drop_written(docs.sparkSession, written() - before - {by_class._written_to})
    drop_held([*held_before, survey])
    every = F.coalesce("class_links", F.lit(0).cast("long")) if count_links else F.lit(None).cast("long")
    return members.join(by_class, "cls", "left").select(
        "doc_id", "n_shingles", F.col("cls").alias("class_id"), every.alias("class_links"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "text_hash",
        "first_hash"
    )


def keep_one_of_each(docs: DataFrame, broadcast_rows: int = 400_000, **options) -> DataFrame:
    """docs with one row of each component, the first by doc_id (nulls last), then by the hash of its text; same columns.

    Rows are told by doc_id and text; of rows equal in both one stays. A text without words is its own component.
    What is known of rows that go or repeat is broadcast if it has at most broadcast_rows rows, some 40 MB, and joined by a shuffle beyond that."""
    before, held_before = written(), held_now()
    own_id, own_hash, gone = private(docs, "__doc_id", "__hash", "__goes")
    found = jaccard_join(docs.select("doc_id", "text"), count_links=False, **options).select("doc_id", "text_hash", "component_id", "first_hash")
    goes = F.col("first_hash").isNotNull() & ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    fate = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.max(goes).alias("goes")).filter("goes or copies > 1")
    fate = fate.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.coalesce("goes", F.lit(False)).alias(gone))
    fate = materialise(fate, "fate", files_for(docs.count()))
    drop_written(docs.sparkSession, written() - before - {fate._written_to})
    drop_held(held_before)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_hash))
    sent = F.broadcast if fate.count() <= broadcast_rows else lambda rows: rows
    kept = docs.join(sent(fate), same, "left_anti")
    again = fate.filter(~F.col(gone))
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(sent(again), same, "inner").dropDuplicates([own_id, own_hash]).select(*map(named, docs.columns)))
