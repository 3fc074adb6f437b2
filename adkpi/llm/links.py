"""Links between similar sets that share a posting key, without a quadratic number of pairs.

Input are postings (key, id) and the sets behind the ids. Wanted are edges whose connected
components equal those of *all* pairs that share a key and are similar enough. Members that
lists connect are a family, and no link leaves one. A family of up to ``FAMILY`` members and a few
megabytes of text meets in one task, each text once however many lists it is in. All pairs of up
to ``_TABLE`` members are counted there; of more members some are compared as leaders, which joins
most near copies, and the pairs of a list that are still apart only if no leader rules a link out
(``_led_inside``). The sets are exact in either case, and no link within a list is lost.

A larger family is dealt into blocks: members whose largest list is the same, with that list's
most central member. Blocks are compared like small families, which joins most near copies at a
cost in proportion to the members. Then all members are compared with one leader, and what that
leaves open is bounded from the leader's intersections, which are then known exactly.
Take members A and B with leader P and without a common element outside P. Then

    |A & B| <= m = min(|A & P|, |B & P|)   and   J(A, B) <= m / (|A| + |B| - m),

which is below the threshold for nearly all pairs; the few others are compared. Pairs with a
common element outside P meet again in the next level, whose keys are (P, element): for a link
B must hold all but a small part of A's elements, so a prefix of each A - P in one order for all
of P's members, the rarest first, is enough. Pairs already in one component are never needed. There,
short lists are compared pair by pair and longer ones with a leader of their own. Every level is
complete; after ``LEVELS`` of them, lists that still span components are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adkpi.llm.components import components, least_reached
from adkpi.llm.shipping import ship
from adkpi.llm.text import mix, order_of, ragged, slices
from adkpi.session import staged

#: Sorted distinct elements of each text, end to end, and their number per text.
Elements = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

FAMILY = 1 << 16
_FAMILY_BYTES = 1 << 24  # of text
# Members of a block are dealt by a hash: so many on average.
_BLOCK = 96
SHORT_LIST = 8
# An element takes many times the bytes of its place in the text.
_PART_BYTES = 1 << 19
LEVELS = 5
_CELLS = 1 << 23
# Members of a group whose pairs are counted in a table.
_TABLE = 2048
_LEADERS = 16
# Of a table of members and elements that is kept.
_BITS = 1 << 29
# Elements that are sorted at once.
_SORTED = 1 << 22


def list_marks(member: str) -> list[Column]:
    """Aggregates ``n, m1, m2``: the length of a list and marks of who is in it."""
    return [
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64(member)).alias("m1"),
        F.bit_xor(F.xxhash64(F.lit(1), member)).alias("m2"),
    ]


def different_lists(lists: DataFrame) -> DataFrame:
    """``key, n`` of one of several lists with the same members.

    Neighbouring elements are often shared by the same sets; one list of them is enough.
    """
    return lists.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key", "n")


def _rows(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def _shared(
    grams: np.ndarray, owner: np.ndarray, home: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each element that two sets of one group have; numbers go by group."""
    # One sort by a hash of element and group, a range of hashes at a time.
    key = mix(grams + home[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    steps = 1 << max(0, (len(key) // _SORTED).bit_length())
    found, count = [], 0
    for step in range(steps):
        here = np.flatnonzero(key // np.uint64((1 << 64) // steps) == np.uint64(step)) if steps > 1 else None
        part = key if here is None else key[here]
        order = order_of(part)
        part = part[order]
        same = part[1:] == part[:-1]
        twice = np.zeros(len(part), bool)
        twice[1:] |= same
        twice[:-1] |= same
        run = np.concatenate(([0], np.cumsum(~same)))[twice]
        at = order[twice] if here is None else here[order[twice]]
        run = np.concatenate(([0], np.cumsum(run[1:] != run[:-1]))) if len(run) else run
        found.append((owner[at], run + count))
        count += int(run[-1]) + 1 if len(run) else 0
    owner, run = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(home[owner], kind="stable")
    return owner[order], run[order]


def _linked(
    grams: np.ndarray, counts: np.ndarray, group: np.ndarray, percent: int, keys: pa.Array
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members (numbers) of one group that connect what links in the group connect.

    Sets are end to end and in the order of their groups; ``keys`` has the lists of each member,
    for groups of more than ``_TABLE``.
    """
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(first, len(group)))
    home = np.repeat(np.arange(len(first)), sizes)
    owner, run = _shared(grams, _rows(counts), home)
    at = home[owner]

    def close(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        similar = both * 100 >= (counts[a] + counts[b] - both) * percent
        return a[similar], b[similar]

    few = sizes[at] <= SHORT_LIST
    member, key = owner[few], run[few]
    both = np.zeros(len(counts) * SHORT_LIST, np.int64)
    order = np.lexsort((member, key))
    member, key = member[order], key[order]
    for step in range(1, SHORT_LIST):
        met = np.flatnonzero(key[step:] == key[:-step])
        if not len(met):
            break
        code = member[met] * SHORT_LIST + member[met + step] - member[met]
        both += np.bincount(code, minlength=len(both))
    code = np.flatnonzero(both)
    out = [close(code // SHORT_LIST, code // SHORT_LIST + code % SHORT_LIST, both[code])]
    owner, at, run = owner[~few], at[~few], run[~few]
    for k in np.unique(at):
        start, stop = np.searchsorted(at, (k, k + 1))
        member = owner[start:stop] - first[k]
        column = np.unique(run[start:stop], return_inverse=True)[1]
        inside = slice(first[k], first[k] + sizes[k])
        if sizes[k] <= _TABLE:
            a, b = _counted(member, column, counts[inside], percent)
        else:
            lists = keys.slice(first[k], sizes[k])
            posted = np.asarray(lists.flatten()), _rows(np.asarray(pc.list_value_length(lists)))
            a, b = _led_inside(member, column, counts[inside], percent, posted)
        out.append((a + first[k], b + first[k]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _counted(
    member: np.ndarray, column: np.ndarray, counts: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """All links of one group, from a table of its members and shared elements."""
    common = np.zeros((len(counts), len(counts)), np.float32)  # whole numbers, exact to 2 to the 24
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    width = _CELLS // len(counts)
    for low in range(0, int(column[-1]) + 1, width):
        left, right = np.searchsorted(column, (low, low + width))
        table = np.zeros((len(counts), int(column[right - 1]) - low + 1), np.float32)
        table[member[left:right], column[left:right] - low] = 1
        common += table @ table.T
    a, b = np.nonzero(np.triu(common, 1))
    both = common[a, b].astype(np.int64)
    similar = both * 100 >= (counts[a] + counts[b] - both) * percent
    return a[similar], b[similar]


def _intersections(member: np.ndarray, column: np.ndarray, size: int) -> Callable:
    """Numbers of common elements of pairs ``a, b`` of members, by one bit an element."""
    wide = int(column.max()) + 1 if len(column) else 1
    width = max(64, min(wide, _BITS // size) // 64 * 64 + 64)
    order = np.argsort(member, kind="stable")
    member, column = member[order], column[order]

    def table(low: int) -> np.ndarray:
        here = (column >= low) & (column < low + width)
        rows, at = member[here], column[here] - low
        bits = np.zeros((size, width // 64), np.uint64)
        step = max(1, _CELLS // width)
        for one in range(0, size, step):
            left, right = np.searchsorted(rows, (one, one + step))
            cells = np.zeros((min(step, size - one), width), bool)
            cells[rows[left:right] - one, at[left:right]] = True
            bits[one : one + step] = np.packbits(cells, axis=1).view(np.uint64)
        return bits

    whole = table(0) if wide <= width else None

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.zeros(len(a), np.int64)
        step = max(1, _CELLS // 8 // (width // 64))
        for low in range(0, wide, width):
            bits = table(low) if whole is None else whole
            for k in range(0, len(a), step):
                one = slice(k, k + step)
                both[one] += np.bitwise_count(bits[a[one]] & bits[b[one]]).sum(axis=1, dtype=np.int64)
        return both

    return common


def _led_inside(
    member: np.ndarray,
    column: np.ndarray,
    counts: np.ndarray,
    percent: int,
    posted: tuple[np.ndarray, np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links within lists (keys, members) of one large group connect.

    Some leaders are compared with all members, which joins most near copies. Pairs of a list that
    are still apart are compared unless a leader rules them out: with P, A and B have
    ``min(|A & P|, |B & P|) + min(|A - P|, |B - P|)`` elements in common at most.
    """
    size = len(counts)
    common = _intersections(member, column, size)

    def close(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
        return both * 100 >= (counts[a] + counts[b] - both) * percent

    company = np.bincount(member, weights=np.bincount(column)[column], minlength=size)
    everyone = np.arange(size)
    pending = np.ones(size, bool)
    leaders, label = [], everyone
    while len(leaders) < _LEADERS and pending.any():
        leader = np.full(size, np.argmax(np.where(pending, company, -1)))
        both = common(leader, everyone)
        both[leader[0]] = counts[leader[0]]
        leaders.append(both)
        near = np.flatnonzero(close(leader, everyone, both))
        pending[near] = False
        label = least_reached(np.append(everyone, leader[near]), np.append(label, near), size)
    key, post = posted
    order = np.lexsort((post, label[post], key))
    key, post = key[order], post[order]
    code = np.unique(key, return_inverse=True)[1] * size + label[post]
    after = np.searchsorted(code, code, "right")  # the first of another component
    other = np.searchsorted(key, key, "right") - after
    # Member by member, so a pair comes once, however many lists it is in.
    turn = np.argsort(post, kind="stable")
    post_of, after, other = post[turn], after[turn], other[turn]
    last = np.searchsorted(post_of, post_of, "right")
    ends = np.cumsum(other)
    start = 0
    while start < len(turn):
        base = ends[start - 1] if start else 0
        most = max(start, int(np.searchsorted(ends, base + _CELLS // 4, "right")) - 1)
        stop = int(last[most])
        a = np.repeat(post_of[start:stop], other[start:stop])
        b = post[ragged(after[start:stop], other[start:stop])]
        start = stop
        keep = label[a] != label[b]
        keep &= np.minimum(counts[a], counts[b]) * 100 >= np.maximum(counts[a], counts[b]) * percent
        pairs = np.unique(np.minimum(a, b)[keep] * size + np.maximum(a, b)[keep])
        a, b = pairs // size, pairs % size
        likely = np.full(len(a), np.inf)
        for both in leaders:
            most = np.minimum(both[a], both[b]) + np.minimum(counts[a] - both[a], counts[b] - both[b])
            keep = close(a, b, most)
            a, b, most = a[keep], b[keep], most[keep]
            likely = np.minimum(likely[keep], most / (counts[a] + counts[b] - most))
        # The likeliest first, as they join what else would be compared over and over.
        order = np.argsort(-likely, kind="stable")
        a, b = a[order], b[order]
        count = 1 << 12
        while len(a):
            one, two = a[:count], b[:count]
            near = close(one, two, common(one, two))
            label = least_reached(np.append(everyone, one[near]), np.append(label, two[near]), size)
            apart = label[a] != label[b]
            apart[:count] = False
            a, b = a[apart], b[apart]
            count *= 2
    hung = np.flatnonzero(label != everyone)
    return label[hung], hung


def links_in_groups(rows: DataFrame, elements: Elements, percent: int) -> DataFrame:
    """Edges ``a, b`` that connect what links within groups connect, from ``grp, id, text``.

    No id is twice in a group, and a group meets in one task. In groups of more than ``_TABLE``
    members only those that have one of their ``keys`` in common need a link; without that
    column all are one list.
    """
    if "keys" not in rows.columns:
        rows = rows.withColumn("keys", F.array(F.lit(0).cast("long")))

    def linked(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [elements(few.column("text")) for few in slices(part, "text")]
        grams, counts = (np.concatenate(x) for x in zip(*sets))
        a, b = _linked(grams, counts, np.asarray(part.column("grp")), percent, part.column("keys"))
        least = least_reached(a, b, len(counts))
        hung = np.flatnonzero(least != np.arange(len(counts)))
        ids = np.asarray(part.column("id"))
        ends = pa.array(ids[least[hung]]), pa.array(ids[hung])
        return pa.RecordBatch.from_arrays(list(ends), names=["a", "b"])

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole groups, several at once."""
        group = np.asarray(batch.column("grp"))
        last = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        begins = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64))
        start = 0
        while start < len(group):
            base = begins[start - 1] if start else 0
            most = np.searchsorted(begins, base + _PART_BYTES, "right")
            stop = last[max(np.searchsorted(last, most, "right") - 1, np.searchsorted(last, start, "right"))]
            yield batch.slice(start, stop - start)
            start = int(stop)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            group = np.asarray(batch.column("grp"))
            stop = int(np.searchsorted(group, group[-1]))  # this group may go on
            for part in whole(batch.slice(0, stop)):
                yield linked(part)
            held = batch.slice(stop)
        if held is not None:
            for part in whole(held):
                yield linked(part)

    dealt = rows.select("grp", "id", "text", "keys").repartition("grp").sortWithinPartitions("grp")
    return staged(dealt.mapInArrow(link, "a long, b long"))


class _Linker:
    def __init__(self, elements: Elements, percent: int):
        self.elements, self.percent = elements, percent
        self.sets: DataFrame | None = None
        self.edges: list[DataFrame] = []

    def compare(self, pairs: DataFrame, screened: bool) -> DataFrame:
        """``a, b, na, nb, both, linked``; ``screened`` leaves out pairs of unlike sizes.

        Texts travel instead of sets, which are several times their size.
        """
        elements, percent = self.elements, self.percent
        left, right = (
            self.sets.select(
                F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("text").alias(f"t{x}")
            )
            for x in "ab"
        )
        if not screened:  # stars: few leaders, many members
            left = left.join(pairs.select("a").distinct(), "a", "left_semi")
        # The members first: leaders (a) repeat, so their texts are joined on without a copy.
        joined = pairs.join(right, "b").join(left, "a")
        if screened:
            unlike = F.least("na", "nb") * 100 < F.greatest("na", "nb") * percent
            joined = joined.filter(~unlike)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "ta", "tb", limit=_PART_BYTES):
                    (one, n1), (two, n2) = elements(part.column("ta")), elements(part.column("tb"))
                    grams, owner = np.concatenate((one, two)), np.concatenate((_rows(n1), _rows(n2)))
                    order = np.lexsort((grams, owner))
                    grams, owner = grams[order], owner[order]
                    twice = (grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])
                    both = np.bincount(owner[1:][twice], minlength=len(n1))
                    linked = both * 100 >= (n1 + n2 - both) * percent
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("a", "b", "na", "nb")), pa.array(both), pa.array(linked)],
                        names=["a", "b", "na", "nb", "both", "linked"],
                    )

        fields = "a long, b long, na long, nb long, both long, linked boolean"
        return staged(joined.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(count, fields))

    def outside(self, groups: DataFrame) -> DataFrame:
        """``key, id``: the rarest elements of members (b) outside their leader (a).

        For a link to an element set of ``n``, all but ``(100 - percent) * n / 100`` of a
        member's elements are shared, so one more than that many outside ones are enough, in
        any one order. Rare ones come first: those of a single member use up most places and
        make no list.
        """
        elements, percent = self.elements, self.percent
        member = self.sets.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        leader = self.sets.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        leader = leader.join(groups.select("a").distinct(), "a", "left_semi")
        joined = groups.select("a", "b").join(member, "b").join(leader, "a")

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "ta", "tb", limit=_PART_BYTES):
                    (one, n1), (two, n2) = elements(part.column("ta")), elements(part.column("tb"))
                    grams, owner = np.concatenate((one, two)), np.concatenate((_rows(n1), _rows(n2)))
                    mine = np.arange(len(grams)) >= len(one)
                    order = np.lexsort((mine, grams, owner))
                    grams, owner, mine = grams[order], owner[order], mine[order]
                    alone = mine.copy()
                    alone[1:] &= (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
                    grams, owner = grams[alone], owner[alone]
                    rows = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("a").take(rows),
                            part.column("b").take(rows),
                            pa.array(grams.view(np.int64)),
                            pa.array((n2 * (100 - percent) // 100 + 1)[owner].astype(np.int32)),
                        ],
                        names=["a", "id", "gram", "places"],
                    )

        fields = "a long, id long, gram long, places int"
        alone = joined.select("a", "b", "ta", "tb").mapInArrow(post, fields)
        # The texts are read once; the elements are needed to be counted and to be ranked.
        alone = staged(alone.dropDuplicates(["a", "id", "gram"]))
        shared = alone.groupBy("a", "gram").agg(F.count("*").alias("_f")).filter("_f > 1")
        ranked = alone.join(shared, ["a", "gram"], "left").withColumn(
            "_place",
            F.row_number().over(Window.partitionBy("a", "id").orderBy(F.coalesce("_f", F.lit(1)), "gram")),
        )
        wanted = ranked.filter("_place <= places and _f is not null")
        return wanted.select(F.xxhash64("a", "gram").alias("key"), "id").distinct()

    def keep(self, compared: DataFrame) -> None:
        self.edges.append(compared.filter("linked").select("a", "b"))

    def keep_edges(self, edges: DataFrame) -> None:
        self.edges.append(edges.select("a", "b"))

    def blocks(self, lists: DataFrame) -> DataFrame:
        """Edges within blocks of members that have their largest list in common."""
        own = lists.groupBy("id").agg(F.max(F.struct("n", "key")).alias("_own"))
        block = F.pmod(F.xxhash64(F.lit(1), "id"), F.ceil(F.col("_own.n") / _BLOCK))
        dealt = own.select(F.xxhash64("_own.key", block).alias("grp"), F.col("_own.key").alias("key"), "id")
        dealt = staged(dealt)
        leaders = _led(lists, lists).select("key", F.col("a").alias("id")).distinct()
        heads = dealt.select("grp", "key").distinct().join(leaders, "key")
        rows = dealt.select("grp", "id").unionAll(heads.select("grp", "id")).distinct()
        return links_in_groups(rows.join(self.sets, "id"), self.elements, self.percent)

    def beyond(self, led: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Compare members with leaders; what may be linked beyond that is compared or posted.

        Postings of the next level, None if nothing is left, and components so far.
        """
        percent = self.percent
        stars = self.compare(led.filter("a <> b").select("a", "b").distinct(), screened=False)
        self.keep(stars)
        known = staged(components(self.all_edges()))
        # Lists that still span components, as groups of one leader.
        open_lists = self.in_components(led.select("key", F.col("b").alias("id")), known)
        groups = staged(
            led.join(open_lists.select("key", F.col("id").alias("b"), "c"), ["key", "b"])
            .filter("a <> b")
            .select("a", "b", "c")
            .distinct()
            .join(stars, ["a", "b"])
        )
        if groups.isEmpty():
            return None, known
        # Pairs that need no element outside the leader: both lie in it but for a small part, and
        # one is no link of it, as links of one leader are one component already. Kinds first, so
        # equal cases meet once.
        within = groups.filter(F.col("both") * 100 >= F.col("nb") * percent)
        kinds = within.groupBy("a", "nb", "both", "linked").agg(
            F.min("c").alias("_l"), F.max("c").alias("_h")
        )
        one, two = (
            kinds.select(
                F.col("a").alias("_p"),
                *(F.col(c).alias(f"{c}{x}") for c in ("nb", "both", "linked", "_l", "_h")),
            )
            for x in "12"
        )
        most = F.least("both1", "both2")
        possible = (
            one.filter("not linked1")
            .join(two, "_p")
            .filter("not (_l1 = _h1 and _l2 = _h2 and _l1 = _l2)")
            .filter(most * 100 >= (F.col("nb1") + F.col("nb2") - most) * percent)
            .select("_p", "nb1", "both1", "linked1", "nb2", "both2", "linked2")
        )
        first, second = (
            within.select(
                F.col("a").alias("_p"),
                *(F.col(c).alias(f"{c}{x}") for c in ("nb", "both", "linked", "b", "c")),
            )
            for x in "12"
        )
        rest = (
            possible.join(first, ["_p", "nb1", "both1", "linked1"])
            .join(second, ["_p", "nb2", "both2", "linked2"])
            .filter("c1 <> c2")
            .select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b"))
            .distinct()
        )
        self.keep(self.compare(rest, screened=True))
        return staged(self.outside(groups)), known

    def all_edges(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.edges)

    def in_components(self, postings: DataFrame, known: DataFrame) -> DataFrame:
        """Postings with ``c``, the component so far, in lists of two components or more."""
        placed = postings.join(known, "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("c")
        )
        spread = placed.groupBy("key").agg(
            F.min("c").alias("_l"), F.max("c").alias("_h"), *list_marks("id")
        )
        return placed.join(different_lists(spread.filter("_l <> _h")), "key")


def _led(lists: DataFrame, central: DataFrame) -> DataFrame:
    """``key, a, b``: every member (b) of a list with the list's leader (a).

    That is the member with most company in the lists of ``central``.
    """
    company = central.groupBy("id").agg(F.sum("n").alias("_d"))
    lists = lists.select("key", "id").distinct()
    leaders = (
        lists.join(company, "id")
        .groupBy("key")
        .agg(F.max(F.struct("_d", (-F.col("id")).alias("m")))["m"].alias("m"))
        .select("key", (-F.col("m")).alias("a"))
    )
    return lists.join(leaders, "key").select("key", "a", F.col("id").alias("b"))


def _pairs_within(lists: DataFrame) -> DataFrame:
    left = lists.select("key", F.col("id").alias("a"), F.col("c").alias("_ca"))
    right = lists.select("key", F.col("id").alias("b"), F.col("c").alias("_cb"))
    return left.join(right, "key").filter("a < b and _ca <> _cb").select("a", "b").distinct()


def _sized(texts: DataFrame, elements: Elements) -> DataFrame:
    """``id, n, text`` with ``n``, the size of the text's set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit=_PART_BYTES):
                sizes = pa.array(elements(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), sizes, part.column("text")], names=["id", "n", "text"]
                )

    return texts.select("id", "text").mapInArrow(measure, "id long, n long, text string")


def linked_pairs(
    postings: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    elements: Elements,
    percent: int,
    unique: bool = False,
) -> DataFrame:
    """Edges ``a, b`` for sets with ``100 * |A & B| >= percent * |A | B|`` that share a key.

    ``postings`` has ``key, id``. ``texts_of(ids)`` gives ``id, text`` for the ids asked for;
    ``elements`` makes sets from texts.
    ``unique`` tells that no posting is there twice, which saves a shuffle. Pairs of a family that
    share no key may be linked too, if they are similar enough.
    """
    ship(postings.sparkSession)
    linker = _Linker(elements, percent)
    every = postings if unique else postings.distinct()
    marks = every.groupBy("key").agg(F.min("id").alias("first"), *list_marks("id")).filter("n > 1")
    marks = marks.groupBy("n", "m1", "m2").agg(F.min("key").alias("key"), F.min("first").alias("first"))
    lists = staged(every.join(marks.select("key", "n", "first"), "key").select("key", "id", "n", "first"))
    if lists.isEmpty():
        return postings.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    ends = lists.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    families = staged(components(ends))
    sets = texts_of(families.select("id")).select("id", "text")
    sets = staged(sets.join(families, "id"))
    sizes = sets.groupBy("component").agg(F.count("*").alias("members"), F.sum(F.octet_length("text")).alias("bytes"))
    beyond = sizes.filter((F.col("members") > FAMILY) | (F.col("bytes") > _FAMILY_BYTES))
    beyond = staged(beyond.select("component"))
    small = sets.join(beyond, "component", "left_anti")
    wide = sizes.filter(F.col("members") > _TABLE).join(beyond, "component", "left_anti")
    wide = staged(wide.select("component"))
    if wide.isEmpty():
        small = small.withColumn("keys", F.lit(None).cast("array<long>"))
    else:
        inside = families.join(wide, "component", "left_semi").select("id")
        keys = lists.join(inside, "id", "left_semi").groupBy("id").agg(F.collect_list("key").alias("keys"))
        small = small.join(keys, "id", "left")
    small = small.withColumnRenamed("component", "grp")
    found = links_in_groups(small, elements, percent)
    if beyond.isEmpty():
        return found
    large = families.join(beyond, "component", "left_semi")
    large = staged(lists.join(large, "id"))
    linker.sets = staged(_sized(sets.join(beyond, "component", "left_semi"), elements))
    linker.keep_edges(linker.blocks(large))
    led = staged(_led(large.select(F.col("component").alias("key"), "id"), large))
    level_postings, known = linker.beyond(led)
    for level in range(LEVELS + 1):
        if level_postings is None:
            break
        lists = staged(linker.in_components(level_postings, known))
        if lists.isEmpty():
            break
        short = lists if level == LEVELS else lists.filter(F.col("n") <= SHORT_LIST)
        linker.keep(linker.compare(_pairs_within(short), screened=True))
        if level == LEVELS:
            break
        long = lists.filter(F.col("n") > SHORT_LIST)
        led = staged(_led(long, long))
        if led.isEmpty():
            break
        # Only long lists matter from here on.
        inside = led.select(F.col("b").alias("id")).distinct()
        linker.sets = staged(linker.sets.join(inside, "id", "left_semi"))
        level_postings, known = linker.beyond(led)
    return found.unionAll(linker.all_edges())
