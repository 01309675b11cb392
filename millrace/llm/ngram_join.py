"""Exact n-gram Jaccard self-join of documents, as classes of documents that links connect.

A document's set has the hashes of its distinct five-word shingles; two documents link when the Jaccard similarity
of their sets is at least 0.8. The result is the component of each document, so that copies are never expanded to pairs.

1. Documents of equal sets are one class; everything below works on classes.
2. A shingle that one class alone has is in no intersection. A class with more than a fifth of such shingles can't
   link to any other. Which classes those are shows in a fixed slice of the hash space (5/16 of it), counted over
   all documents, so most of a corpus leaves after one narrow shuffle.
3. The sets of the classes that stay are put into one global order, rarest shingle first, and stripped of shingles
   that only one class has. Linked sets share a shingle of their prefixes (all but the 80 % that they must share).
4. Sets to be compared are stored in a prefix tree whose nodes know the smallest size and the longest set below them.
   A probe walks down with its overlap so far, shared by all sets below a node, and leaves out every subtree where
   what remains can't reach the overlap that even the smallest set asks for.
5. What is compared: in each list of a prefix shingle first everything with one leader, by rounds, as long as lists hold
   more unlinked pairs than rows; then, exactly, every pair of a list that no links connect yet. Pairs
   that links already connect need no comparison, so a group of thousands of near copies costs about its rows. Lists
   with the same members count as one.
6. Of a list that is still longer than ``TREE_SETS``, the sets outside its largest component are compared with all,
   in blocks of sets whose sizes may link (within a factor of 1.25); no block is larger than the trees.

A shingle's list may hold a third of all classes: how often a shingle occurs is known from step 3, and lists are dealt
to parts of about ``LIST_PART`` rows, so that no task gets a whole one.

Defined results: words are compared with A-Z lower-cased; a text of fewer than five words is one shingle; a null or
blank text has an empty set, links with nothing and is its own component; rows with a null id have a size but no
component and take no part; rows that share an id are one document, which has the links of all of them; texts are
read whole, a very long one alone; ids are whole numbers (others fail to cast); an empty table gives an empty table;
other columns are not carried.

Sets hold 64-bit hashes of shingles; a class is known by the 128 bits of its set's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.llm.common import bounded, column, every, unique_name, written
from millrace.llm.components import components

WIDTH = 5
#: Links need 100 * intersection >= NEED * union.
NEED = 80
#: The counted part of the hash space, in sixteenths.
SLICE = 5
#: Sets in one prefix tree, about.
TREE_SETS = 256
#: Partners that one probe is compared with in one task.
PARTNERS = 64
#: Rows of a list that are worked on together, about.
LIST_PART = 256
#: Sets of which the sizes link are in the same class of sizes or in neighbouring ones; a little over 100 / NEED.
SIZE_STEP = 1.26
LEADER_ROUNDS = 3


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, shingle set) of (id, text) rows."""
    for b in batches:
        for row, chunk in tx.chunks(b.column(1)):
            ids = b.column(0).slice(row, len(chunk)).to_pylist()
            yield from zip(ids, tx.shingle_sets(chunk, WIDTH), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def class_members(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key, key2) of (doc_id, text) rows; the keys are null for an empty set."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_shingles", "key", "key2")])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((i, len(s), *(class_key(s) if len(s) else (None, None))) for i, s in _sets(batches)), schema)

    return docs.mapInArrow(members, "doc_id long, n_shingles long, key long, key2 long")


def sliced_shingles(docs: DataFrame, slice_: int = SLICE) -> DataFrame:
    """(token, key): the shingles of the counted slice, once for each class and partition."""
    limit = np.uint64(slice_ << 60)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        parts, keys, size = [], [], 0

        def out() -> pa.RecordBatch:
            token = np.concatenate(parts).view(np.int64)
            key = np.repeat(np.array(keys, dtype=np.int64), [len(p) for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(key)], names=["token", "key"])

        for _, s in _sets(batches):
            if not len(s) or (key := class_key(s)) in seen:
                continue
            seen.add(key)
            parts.append(s[s < limit])  # sets are sorted; the hash is well mixed, so its low values are a sample of shingles
            keys.append(key[0])
            size += len(parts[-1])
            if size > 100_000:
                yield out()
                parts, keys, size = [], [], 0
        if parts:
            yield out()

    return docs.mapInArrow(tokens, "token long, key long")


def classes_of(members: DataFrame) -> DataFrame:
    """(cls, key, key2, n, rep): a number for each class; ``rep`` is the smallest id of the class."""
    grouped = members.where("key IS NOT NULL").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    return written(grouped.withColumn("cls", F.monotonically_increasing_id()))


def surviving_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The classes that may have a partner."""
    owners = sliced_shingles(docs).groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    alone = owners.where("key = other").groupBy("key").agg(F.count(F.lit(1)).alias("n_alone"))
    # Classes that share half of their digest (next to never) can't be told apart here, so they all stay.
    judged = classes.join(alone, "key", "left").withColumn("same_key", F.count(F.lit(1)).over(W.partitionBy("key")))
    slack = F.floor(F.col("n") * (100 - NEED) / 100)
    return judged.where((F.coalesce("n_alone", F.lit(0)) <= slack) | (F.col("same_key") > 1)).select(classes.columns)


def surviving_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, tokens) of the classes' representatives."""
    schema = pa.schema([("cls", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    texts = docs.join(bounded(classes.select(F.col("rep").alias("doc_id"), "cls", "key", "key2")), "doc_id").select("doc_id", "text", "cls", "key", "key2")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def mine() -> Iterator[tuple]:
            for b in batches:
                wanted = list(zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True))
                for (cls, *key), (_, s) in zip(wanted, _sets(iter([b])), strict=True):
                    if len(s) and class_key(s) == tuple(key):  # an id may stand with other texts too
                        yield cls, s.view(np.int64)

        yield from _batched(mine(), schema, 500)

    return texts.mapInArrow(tokens, "cls long, tokens array<long>")


def ordered_sets(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, alone, tokens, head): shared shingles of each class, rarest first; ``alone`` counts the others, ``head`` is the prefix with frequencies."""
    rows = sets.select("cls", F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = rows.join(shared, "token").groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("pairs"))
    out = kept.join(classes.select("cls", "n"), "cls").withColumn("alone", F.col("n") - F.size("pairs"))
    slack = F.floor(F.col("n") * (100 - NEED) / 100)
    head = F.slice("pairs", F.lit(1), (slack + 1 - F.col("alone")).cast("int"))
    return out.where(F.col("alone") <= slack).select("cls", "n", "alone", F.transform("pairs", lambda x: x["token"]).alias("tokens"), head.alias("head"))


def required_overlap(n_a: int, n_b: int) -> int:
    return -(-NEED * (n_a + n_b) // (100 + NEED))


def shared_head(a: np.ndarray, b: np.ndarray) -> int:
    """How many first tokens two ordered sets have in common."""
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    return int(differ[0]) if len(differ) else k


@dataclass
class Node:
    """A node of the prefix tree: the tokens from its parent's end to its own, and what is known of the sets below."""

    run: np.ndarray
    least_n: int
    most: int  # tokens of the longest set below, from the root
    label: object  # the one label of all sets below, or None
    ends: list[tuple]
    children: list[Node]


def grow(sets: list[tuple]) -> Node:
    """The prefix tree of sets (key, full size, tokens, label)."""
    ranked = sorted(sets, key=lambda s: s[2].tobytes())  # sets with equal heads stand together, the shortest first

    def node(part: list[tuple], depth: int) -> Node:
        end = depth + shared_head(part[0][2][depth:], part[-1][2][depth:])
        ends = [s for s in part if len(s[2]) == end]
        children, first = [], len(ends)
        while first < len(part):
            last = first + 1
            while last < len(part) and part[last][2][end] == part[first][2][end]:
                last += 1
            children.append(node(part[first:last], end))
            first = last
        labels = {s[3] for s in part}
        return Node(part[0][2][depth:end], min(s[1] for s in part), max(len(s[2]) for s in part), labels.pop() if len(labels) == 1 else None, ends, children)

    return node(ranked, 0)


def walk(tree: Node, probe: np.ndarray, n_probe: int, own: Callable[[object], bool] = lambda label: False, step: int = 64) -> Iterator[tuple]:
    """The sets of a tree that link with the probe, but for those whose label is ``own``; ``probe`` holds its ordered tokens."""
    ranked = np.sort(probe)
    open_nodes = [(tree, 0, 0)]
    while open_nodes:
        node, depth, hits = open_nodes.pop()
        if node.label is not None and own(node.label):
            continue
        need, at = required_overlap(n_probe, node.least_n), 0
        while hits + min(node.most - depth, len(ranked) - hits) >= need:
            if at == len(node.run):
                yield from (s for s in node.ends if hits >= required_overlap(n_probe, s[1]) and not own(s[3]))
                open_nodes += [(c, depth, hits) for c in node.children]
                break
            part = node.run[at : at + step]
            place = np.minimum(np.searchsorted(ranked, part), len(ranked) - 1)
            hits += int(np.count_nonzero(ranked[place] == part))
            at, depth = at + len(part), depth + len(part)


def tree_join(probe: np.ndarray, n_probe: int, sets: list[tuple[int, int, np.ndarray]]) -> list[int]:
    """Keys of the ordered ``sets`` (key, full size, tokens) that link with the probe."""
    return [s[0] for s in walk(grow([(*s, None) for s in sets]), probe, n_probe)]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs (hub a, partner b) that link."""
    sets = sets.select("cls", "n", "tokens")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    hubs = chunks.join(sets, chunks["a"] == sets["cls"]).select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "n", "tokens")
    partners = dealt.join(sets, dealt["b"] == sets["cls"]).select("a", "chunk", "b", "n", "tokens")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = hubs.union(partners).repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links() -> Iterator[tuple[int, int]]:
            group, probe, n_probe, waiting = None, None, 0, []
            for batch in batches:
                a, chunk, b, size = (batch.column(i).to_pylist() for i in range(4))
                tokens = batch.column(4)
                values, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
                for i in range(batch.num_rows):
                    mine = values[at[i] : at[i + 1]].copy()
                    if (a[i], chunk[i]) != group:
                        if waiting:
                            yield from ((group[0], x) for x in tree_join(probe, n_probe, waiting))
                        group, probe, n_probe, waiting = (a[i], chunk[i]), mine, size[i], []
                    elif b[i] is not None:
                        waiting.append((b[i], size[i], mine))
                        if len(waiting) == TREE_SETS:
                            yield from ((group[0], x) for x in tree_join(probe, n_probe, waiting))
                            waiting = []
            if waiting:
                yield from ((group[0], x) for x in tree_join(probe, n_probe, waiting))

        yield from _batched(links(), schema)

    return grouped.mapInArrow(compare, "a long, b long")


def _may_link() -> Column:
    """By the sizes na, nb and the largest overlaps ma, mb."""
    return F.least("ma", "mb") >= _required("na", "nb")


def with_list(rows: DataFrame, lists: DataFrame, keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """``rows`` (token, part, ...) with the columns of their list; ``lists`` has ``parts``, the number of its parts."""
    dealt = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return rows.join(dealt, [*keys, "part"])


def block_links(rows: DataFrame, mains: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between components in long lists, from ``rows`` (token, part, parts, cls, n, comp).

    ``mains`` has each list's largest component. In each list a set outside of it (left) is compared with every set
    (right) whose size may link. Both are dealt to blocks of about ``TREE_SETS`` by class of sizes, and every pair of
    a left and a right block is one small comparison of the left sets with the prefix tree of the right ones.
    """
    sized = with_list(rows, mains).withColumn("size", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")).withColumn("left", F.col("comp") != F.col("main"))
    sized = written(sized.select("token", "part", "parts", "cls", "n", "comp", "left", "size"))
    sizes = sized.groupBy("token", "size").agg(F.max("parts").alias("parts"), F.ceil(F.count_if("left") / TREE_SETS).cast("int").alias("lefts"), F.ceil(F.count(F.lit(1)) / TREE_SETS).cast("int").alias("rights"))
    around = sizes.select("token", F.explode(F.array(*[F.struct((F.col("size") - d).alias("size"), F.lit(d).alias("d"), F.col("lefts").alias("lefts"), F.col("rights").alias("rights")) for d in (-1, 0, 1)])).alias("x"))
    near = around.groupBy("token", F.col("x.size").alias("size")).agg(F.collect_list(F.struct("x.d", "x.lefts", "x.rights")).alias("near"))
    placed = with_list(sized, sizes.select("token", "size", "parts", "lefts", "rights").join(near, ["token", "size"]), ("token", "size"))

    def tasks(x: Column) -> Column:
        other, no = F.col("size") + x["d"], F.array().cast("array<int>")
        lefts, rights = (F.when(x[k] > 0, F.sequence(F.lit(0), x[k] - 1)).otherwise(no) for k in ("lefts", "rights"))
        as_left = F.transform(rights, lambda r: F.struct(F.col("size").alias("i_size"), other.alias("j_size"), F.pmod(F.xxhash64("cls"), F.greatest("lefts", F.lit(1))).cast("int").alias("i"), r.alias("j"), F.lit(True).alias("probe")))
        as_right = F.transform(lefts, lambda l: F.struct(other.alias("i_size"), F.col("size").alias("j_size"), l.alias("i"), F.pmod(F.xxhash64("cls"), F.col("rights")).cast("int").alias("j"), F.lit(False).alias("probe")))
        return F.concat(F.when(F.col("left"), as_left).otherwise(F.slice(as_left, 1, 0)), as_right)

    keyed = placed.select("token", "cls", "comp", "left", F.explode(F.flatten(F.transform("near", tasks))).alias("t")).select("token", "t.*", "cls", "comp", "left")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["token", "i_size", "j_size", "i", "j"]
    grouped = keyed.join(sets.select("cls", "n", "tokens"), "cls").select(*key, "probe", "cls", "n", "comp", "left", "tokens").repartition(n, *key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            here, group = None, ([], [])
            for batch in batches:
                keys = list(zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True))
                probe, cls, size, comp, left = (batch.column(k).to_pylist() for k in range(5, 10))
                tokens = batch.column(10)
                values, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
                for k in range(batch.num_rows):
                    if keys[k] != here:
                        yield from compare_blocks(*group)
                        here, group = keys[k], ([], [])
                    group[0 if probe[k] else 1].append((cls[k], size[k], values[at[k] : at[k + 1]].copy(), comp[k], left[k]))
            yield from compare_blocks(*group)

        yield from _batched(links(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return grouped.mapInArrow(compare, "a long, b long")


def compare_blocks(probes: list[tuple], others: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links across components between the rows of two blocks (id, size, tokens, component, left).

    Components that a link has joined here are one from then on, so a block gives fewer links than it has sets.
    """
    if not probes or not others:
        return
    tree, above = grow(others), {}

    def root(comp: int) -> int:
        while comp in above:
            comp = above[comp]
        return comp

    for cls, n, tokens, comp, _ in probes:
        for s in walk(tree, tokens, n, lambda label, mine=comp: root(label) == root(mine)):
            yield cls, s[0]
            above[root(s[3])] = root(comp)


def _after_prefix(n: str):
    return F.ceil(F.col(n) * NEED / 100) - 1


def _required(a: str, b: str):
    return F.ceil((F.col(a) + F.col(b)) * NEED / (100 + NEED))


def open_lists(rows: DataFrame) -> DataFrame:
    """(token, parts, least_n, weight) of the lists that hold several components; of lists with equal members one, with the weight of all."""
    members = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    lists = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("n").alias("least_n"), F.max("parts").alias("parts"), F.max("weight").alias("weight"), F.count(F.lit(1)).alias("size"), *members)
    kept = lists.where("x <> y").groupBy("size", "h0", "h1").agg(F.min(F.struct("token", "parts", "least_n")).alias("l"), F.sum("weight").alias("weight"))
    return kept.select("l.*", "weight")


def linked_classes(sets: DataFrame) -> DataFrame:
    """(cls, component) of the classes that link with another, from ordered sets."""
    # most: the overlap that a set can have at all
    postings = sets.select("cls", "n", F.size("tokens").alias("most"), F.explode("head").alias("h"))
    parts = F.ceil(F.col("h.df") / LIST_PART).cast("int")
    postings = postings.select("cls", "n", "most", F.col("h.token").alias("token"), parts.alias("parts"), F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"), F.lit(1).cast("long").alias("weight"))
    comps = written(sets.select("cls", F.col("cls").alias("comp")))
    done, before = None, None
    for turn in range(LEADER_ROUNDS + 1):
        # Lists within one component are done for good, and so is a set in a list where even the smallest set asks for too much.
        rows = written(postings.join(comps, "cls"))
        rows = written(with_list(rows.drop("weight"), open_lists(rows)).where(_required("n", "least_n") <= F.col("most")).drop("least_n"))
        postings = rows.drop("comp")
        # A pair across components has a member outside the list's main component.
        by_comp = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"), F.max("parts").alias("parts"))
        main = by_comp.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("rows"), F.max("parts").alias("parts"))
        main = written(main.select("token", "parts", F.col("main.comp").alias("main"), (F.col("rows") * (F.col("rows") - F.col("main.size"))).alias("open"), "rows"))
        left = main.agg(F.sum("open").alias("open"), F.sum("rows").alias("rows"), F.max("rows").alias("longest")).first()
        if not left["rows"]:
            break
        last = turn == LEADER_ROUNDS or left["open"] <= 4 * left["rows"] or (before is not None and 2 * left["open"] > before)
        before = left["open"]
        links = None
        if last:
            # A pair that shares a long list is compared in blocks; all lists of any other pair are short.
            if left["longest"] > TREE_SETS:
                long_rows = with_list(rows, main.where(F.col("rows") > TREE_SETS).select("token", "parts", F.lit(True).alias("long"))).drop("long")
                links = written(block_links(long_rows, main.where(F.col("rows") > TREE_SETS).select("token", "parts", "main"), sets))
            rows = with_list(rows, main.where(F.col("rows") <= TREE_SETS).select("token", "parts", "main"))
            outside = rows.where("comp <> main").select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("comp").alias("ca"), "main")
            pairs = outside.join(rows.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("comp").alias("cb"), "weight"), "token")
            # Two members outside the main component meet twice; once is enough.
            pairs = pairs.where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))))
            # Main components differ from list to list, so the pair's order is fixed only now.
            pairs = pairs.where(_may_link()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"), "weight")
            # Of the set whose prefix ends first, all shared prefix shingles are counted here; the rest of it adds at most what follows.
            pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("weight").alias("shared")).where(F.col("shared") + F.greatest(_after_prefix("na"), _after_prefix("nb")) >= _required("na", "nb")).select("a", "b")
        else:
            leader = rows.groupBy("token").agg(F.max("parts").alias("parts"), F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("comp").alias("ca"))).alias("l")).select("token", "parts", "l.a", "l.na", "l.ma", "l.ca")
            pairs = with_list(rows.select("token", "part", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("comp").alias("cb")), leader).where("ca <> cb")
            pairs = pairs.where(_may_link()).select("a", "b").distinct()
        if done is not None:
            seen = done.union(done.select("b", "a")).toDF("a", "b")
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = written(pairs)
        done = pairs if done is None else done.union(pairs)
        links = verified(pairs, sets) if links is None else verified(pairs, sets).union(links)
        to = comps.select(F.col("cls").alias("a"), F.col("comp").alias("ca"))
        over = comps.select(F.col("cls").alias("b"), F.col("comp").alias("cb"))
        between = written(links).join(to, "a").join(over, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(between)
        comps = written(comps.join(joined, comps["comp"] == joined["id"], "left").select("cls", F.coalesce("component", "comp").alias("comp")))
        if last:
            break
    return comps.withColumnRenamed("comp", "component")


def joined_by_ids(members: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """``comps`` (cls, component) after the classes of rows that share an id are joined."""
    key = F.struct("key", "key2")
    several = members.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    if not several.limit(1).count():
        return comps
    shared = members.join(several, "doc_id").join(classes, ["key", "key2"]).select("doc_id", "cls").distinct()
    shared = written(shared.join(comps, "cls", "left").select("doc_id", "cls", F.coalesce("component", "cls").alias("component")))
    least = shared.groupBy("doc_id").agg(F.min("component").alias("a"))
    joined = components(shared.join(least, "doc_id").select("a", F.col("component").alias("b"))).withColumnRenamed("component", "to")
    every_one = comps.union(shared.select("cls", "component")).distinct()
    return every_one.join(joined, every_one["component"] == joined["id"], "left").select("cls", F.coalesce("to", "component").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; ``component_id`` is the smallest id that links reach."""
    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    members = written(class_members(slim))
    known, named = slim.where("doc_id IS NOT NULL"), members.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = classes_of(named)
    alive = written(surviving_classes(classes, known))
    sets = written(ordered_sets(written(surviving_sets(known, alive)), alive))
    comps = joined_by_ids(named, classes, linked_classes(sets))
    linked = written(comps.join(classes.select("cls", "key", "key2"), "cls").select("key", "key2", "component"))
    with_comp = members.join(bounded(linked), ["key", "key2"], "left")
    # A class without links is its own component, known by its key.
    group = {"linked": F.col("component").isNotNull(), "g": F.coalesce("component", "key"), "g2": F.when(F.col("component").isNull(), F.col("key2")).otherwise(0)}
    with_comp = written(with_comp.select("doc_id", "n_shingles", *[c.alias(k) for k, c in group.items()]))
    # Written first, so that the join reads both sides from shuffles and Spark can split a component of very many documents.
    smallest = written(with_comp.where("g IS NOT NULL AND doc_id IS NOT NULL").groupBy(*group).agg(F.min("doc_id").alias("component_id")))
    out = with_comp.join(smallest, list(group), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that link (over any way) to one of a smaller id.

    Of rows that share an id one stays: the one whose text has the smallest hash. Rows with a null id all stay.
    """
    comps = jaccard_components(docs, id_col, text_col).where("doc_id IS NOT NULL")
    ids = comps.groupBy(F.col("doc_id").alias(id_col)).agg(F.max(F.col("component_id") < F.col("doc_id")).alias("linked"), F.count(F.lit(1)).alias("rows"))
    ids = written(ids.where("linked OR rows > 1"))
    kept = docs.join(ids.where("linked").select(id_col), id_col, "left_anti").select(*every(docs))
    again = ids.where("NOT linked").select(id_col)
    if not again.limit(1).count():
        return kept
    row = unique_name(docs, "row")
    one = kept.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*every(docs)), F.xxhash64(text_col)).alias(row))
    return kept.join(again, id_col, "left_anti").select(*every(docs)).union(one.select(f"{row}.*"))


def op2_ngram_join(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM d
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN reach ON reach.a = doc_id
"""
