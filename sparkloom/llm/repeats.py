"""Operator 7. Maximal repeats from a sparse enhanced suffix array and its interval tree.

Wanted are all maximal repeats of at least `min_words` words: passages that
cannot be extended to the left or right without losing an occurrence, each with
all its occurrences, in one document or many.

1. Equal texts are collapsed by digest: the least doc_id stands for its class in
   all that follows, and the class is reported as a repeat itself, from end to end,
   with all its documents.
2. Anchors: of every window of W = min_words - GRAM + 1 successive word GRAM-grams
   the least hash is selected, so every repeat long enough holds an anchor at the same place in
   each occurrence. Anchors are aggregated by hash, on the map side first; those that occur once are gone. So are, as starting
   points, those whose W words to the left are the same everywhere: nothing can
   start there, the left-extension test in its cheapest form.
3. Each remaining anchor is a suffix of the array: its text goes right as far as
   anchors are shared, plus one window, beyond which no repeat can reach, and
   W words left. Suffixes are sorted within their anchor group, which holds every
   suffix they can share `min_words` words with.
4. A stack scan over the longest common prefixes gives the interval tree. In each
   interval a second stack scan, over the left contexts, gives the sets that agree for l words to the
   left and r to the right; a set is a maximal repeat if it is diverse at both ends. It is
   reported from the anchor that is least in its first window, which every occurrence has.
   Of the equal grams in a run of one word the first and the last are anchors: a repeat that begins within a run, which
   may begin earlier in another occurrence, is reported from the last, whose left context holds the whole run.

Hot groups: an anchor of more than `hot_rows` places is not given to one task. The
root of its interval tree is found by an aggregation (what the least and the
greatest suffix share, all share), its children by a hash of the next word, and
so on down until a subtree is small enough for a task; within each such node the
left contexts are split in the same way. Each round is checkpointed.

Nothing is capped: a repeat of more than `piece` occurrences is reported in several
rows, so no row and no task holds an unbounded list. No document is compared with another outside an anchor
group. Hashes select and route; comparison is of the words themselves.

Defined cases: words stand between white space, whose kind and amount don't
matter; null, empty and short texts have no repeats; rows with a null doc_id are left out; rows that repeat
a doc_id and text are one document; a doc_id with several texts has the repeats of each;
a repeat that is nothing but one repeated word is represented
by the starts of its runs, not by their overlapping parts; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut

from .arrowtext import SLICE_BYTES, VERBATIM, gram_hashes, mix, range_hash, slices, words

MIN_WORDS = 40
GRAM = 12
#: Places of an anchor that one task takes at once (some 64 MB of contexts); groups of more are split.
HOT_ROWS = 1 << 16
#: Occurrences in a row of the result.
PIECE = 1000
_ANCHORS = "g bigint, cid bigint, pos int, left bigint"
_CONTEXTS = "node bigint, cid bigint, pos int, left binary, right binary, reign bigint, doc_id bigint"
_FOUND = "least_cid bigint, least_start int, n_words int, n_occurrences bigint, part int, doc_ids array<bigint>, starts array<int>"


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i:i + w], for each i with a whole window."""
    k, m = 1, x
    while 2 * k <= w:
        m = op(m[:-k], m[k:])
        k *= 2
    return op(m[: len(x) - w + 1], m[w - k : w - k + len(x) - w + 1]) if k < w else m


def select_anchors(first: np.ndarray, h: np.ndarray, gram: int, window: int, with_reigns: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, spans, reigns) of the selected grams of all texts; text i has words first[i]:first[i + 1].

    In a run of one word grams are equal; its first and last can be selected. A span is the number of grams from one to the
    other, negative for the last, 0 where there is but one. A reign is (span * window + l) * window + r for a gram that is
    below all within l grams to the left, and that none is below within r to the right, both less than the window; for the
    last gram of a run it is span * window - r, below 0.
    """
    g = gram_hashes(h, gram)
    none = np.zeros(0, np.int64), g[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(g):
        return none
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    end = np.repeat(first[1:], np.diff(first))[: len(g)]
    at = np.arange(len(g))
    whole = at + gram <= end
    g = np.where(whole, g, top)
    if len(g) < window:
        return none
    least = _slide(g, window, np.minimum)
    least = np.where(np.arange(len(least)) + window - 1 + gram <= end[: len(least)], least, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    highest = _slide(np.concatenate([pad, least, pad]), window, np.maximum)  # over the windows that hold i
    chosen = (g == highest) & whole
    same = (g[1:] == g[:-1]) & whole[:-1] & (end[1:] == end[:-1])
    goes_on, came = np.append(same, False), np.append(False, same)
    chosen &= ~(goes_on & came)
    spans = np.zeros(len(g), np.int64)
    begins, ends = np.flatnonzero(goes_on & ~came), np.flatnonzero(came & ~goes_on)
    spans[begins], spans[ends] = ends - begins, begins - ends
    at = np.flatnonzero(chosen)
    spans = spans[at]
    if not with_reigns:
        return at, g[at], spans, none[0]
    reach = []
    for way in (-1, 1):
        n, live = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(1, window):
            other = at[live] + way * k
            there = g[np.clip(other, 0, len(g) - 1)]
            live = live[(other < 0) | (other >= len(g)) | (there > g[at[live]]) | ((there == g[at[live]]) & (way > 0))]  # of equals the first reigns
            n[live] = k
        reach.append(n)
    return at, g[at], spans, np.where(spans < 0, spans * window - reach[1], (spans * window + reach[0]) * window + reach[1])


def anchors(texts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """_ANCHORS of texts(cid, text), once for the equal texts of a task."""
    window = min_words - gram + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for c in batch.column(0).to_pylist():
                fresh.append(c not in seen)
                seen.add(c)
            for part in slices(batch.filter(pa.array(fresh, pa.bool_()))):
                w = words(part.column(1), VERBATIM)
                h = w.hashes()
                at, g, spans, _ = select_anchors(w.first, h, gram, window, False)
                if not len(at):
                    continue
                doc = w.doc[at]
                cid = part.column(0).to_numpy()[doc]
                begin = w.first[doc]
                left = range_hash(h, np.maximum(at - window, begin), at)
                # a text's start differs from any other context
                left = np.where(at - window < begin, mix(left + cid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), left)
                # a repeat may begin anywhere in the run that ends here
                left = np.where(spans < 0, mix((cid ^ (at - begin)).view(np.uint64)), left)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(cid), pa.array((at - begin).astype(np.int32)), pa.array(left.view(np.int64))], ["g", "cid", "pos", "left"])

    return texts.mapInArrow(rows, _ANCHORS)


def _text_words(text: str) -> list[bytes]:
    """The words without the byte 0, which stands between them in a context and sorts before all others."""
    raw = text.encode("utf-8", "replace")
    if b"\0" in raw or b"\1" in raw:
        raw = raw.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")
    return raw.split()


def _common(a: bytes, b: bytes) -> int:
    """Words that contexts a and b begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        lo = n
    else:
        lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
        step = 64
        while lo + step < hi and a[lo : lo + step] == b[lo : lo + step]:
            lo += step
            step *= 2
        hi = min(hi, lo + step)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid
    if lo == 0:
        return 0
    done = (lo == len(a) or a[lo] == 0) and (lo == len(b) or b[lo] == 0)
    return a.count(b"\0", 0, lo) + done


def _next_word(context: bytes, n: int, cid: int, pos: int) -> int:
    """A hash of the word after the first n; a context that ends there differs from all others."""
    parts = context.split(b"\0", n + 1) if context else []
    return xxhash.xxh3_64_intdigest(b"w" + parts[n] if n < len(parts) else b"e%d %d" % (cid, pos)) - (1 << 63)


def intervals(lcp: list[int], n: int) -> list[tuple[int, int, int]]:
    """(prefix, first, last) of the inner nodes of the interval tree; lcp[i] is that of suffixes i - 1 and i."""
    out, stack = [], []
    for i in range(1, n + 1):
        now = lcp[i] if i < n else -1
        first = i - 1
        while stack and now < stack[-1][0]:
            depth, first = stack.pop()
            if i - 1 > first:
                out.append((depth, first, i - 1))
        if not stack or now > stack[-1][0]:
            stack.append((now, first))
    return out


def maximal_at(r: int, lefts: list[bytes], children: list[int], window: int, min_words: int) -> Iterator[tuple[int, list[int]]]:
    """(l, members) of the maximal repeats among suffixes that share r words and go on as their children say."""
    order = sorted(range(len(lefts)), key=lefts.__getitem__)
    lcp = [0] + [_common(lefts[x], lefts[y]) for x, y in zip(order, order[1:])]
    for left, i, j in intervals(lcp, len(order)):
        if left + r < min_words:
            continue
        members = order[i : j + 1]
        if len({children[x] for x in members}) > 1:
            yield left, members


def maximal(lefts: list[bytes], rights: list[bytes], window: int, min_words: int) -> Iterator[tuple[int, int, list[int]]]:
    """One after another, (l, r, members) of the maximal repeats of one anchor group; rights are sorted."""
    n = len(rights)
    if n == 2:
        r, left = _common(rights[0], rights[1]), _common(lefts[0], lefts[1])
        if left + r >= min_words:
            yield left, r, [0, 1]
        return
    lcp = [0] + [_common(rights[i - 1], rights[i]) for i in range(1, n)]
    for r, a, b in intervals(lcp, n):
        if r + window - 1 < min_words:
            continue
        children, c = [0], 0
        for i in range(a + 1, b + 1):
            c += lcp[i] == r
            children.append(c)
        for left, who in maximal_at(r, lefts[a : b + 1], children, window, min_words):
            yield left, r, [a + x for x in who]


def _found_batches(found: Iterator[tuple[int, np.ndarray]], piece: int) -> Iterator[pa.RecordBatch]:
    """_FOUND of repeats (words, places: cid, start, doc_id), in batches."""
    rows, cells, held = [], [], 0

    def flush() -> pa.RecordBatch:
        flat = np.concatenate(cells)
        offs = pa.array(np.cumsum([0, *map(len, cells)]).astype(np.int32))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        lists = pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(flat[:, 2]))), pa.ListArray.from_arrays(offs, pa.array(flat[:, 1].astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *lists], [x.split()[0] for x in _FOUND.split(", ")])

    for size, places in found:
        least = places[np.lexsort((places[:, 1], places[:, 0]))[0]].tolist()
        places = places[np.lexsort((places[:, 1], places[:, 2]))]
        for part, at in enumerate(range(0, len(places), piece)):
            rows.append((*least[:2], size, len(places), part))
            cells.append(places[at : at + piece])
            held += len(cells[-1])
            if held > 50_000:
                yield flush()
                rows, cells, held = [], [], 0
    if held:
        yield flush()


def _reports(left: int, right: int, reign: int, window: int, gram: int) -> bool:
    """Is an anchor of this reign the one that reports a repeat from `left` words before it to `right` after? If not, other occurrences may lack it.

    That is the first of the least grams of the repeat's first window; but the last of its run, if the repeat begins within the run and ends after it.
    """
    if reign < 0:
        span, after = divmod(-reign, window)
        return left <= span and window - 1 - left <= after and right > gram
    before, after = divmod(reign, window)
    span, before = divmod(before, window)
    return left <= before and window - 1 - left <= after and (left > 0 or span == 0 or right <= span + gram)


def trees(suffixes: DataFrame, window: int, min_words: int, piece: int) -> DataFrame:
    """_FOUND of suffixes(_CONTEXTS), each node's in one task."""

    def repeats_of(group: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        places = np.array([(x[0], x[1], x[5]) for x in group], np.int64)
        for left, r, who in maximal([x[2] for x in group], [x[3] for x in group], window, min_words):
            if _reports(left, r, group[who[0]][4], window, min_words - window + 1):
                yield left + r, places[who] - [0, left, 0]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        now, group = None, []
        for part in (part for batch in batches for part in slices(batch, "right")):
            for node, cid, pos, *rest in zip(*(part.column(i).to_pylist() for i in range(7))):
                if node != now:
                    if len(group) > 1:
                        yield from repeats_of(group)
                    now, group = node, []
                if not group or group[-1][:2] != (cid, pos):  # else a row of the table that came twice
                    group.append((cid, pos, *rest))
        if len(group) > 1:
            yield from repeats_of(group)

    return suffixes.repartition("node").sortWithinPartitions("node", "right", "cid", "pos").mapInArrow(lambda batches: _found_batches(groups(batches), piece), _FOUND)


def left_trees(rows: DataFrame, window: int, min_words: int, piece: int) -> DataFrame:
    """_FOUND of rows(node, r, cid, pos, left, reign, child, doc_id), each node's in one task."""

    def repeats_of(group: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        places = np.array([(x[1], x[2], x[6]) for x in group], np.int64)
        for left, who in maximal_at(group[0][0], [x[3] for x in group], [x[5] for x in group], window, min_words):
            if _reports(left, group[0][0], group[who[0]][4], window, min_words - window + 1):
                yield left + group[0][0], places[who] - [0, left, 0]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        now, group = None, []
        for batch in batches:
            for node, *row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if node != now:
                    if len(group) > 1:
                        yield from repeats_of(group)
                    now, group = node, []
                group.append(row)
        if len(group) > 1:
            yield from repeats_of(group)

    rows = rows.select("node", "r", "cid", "pos", "left", "reign", "child", "doc_id").repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(lambda batches: _found_batches(groups(batches), piece), _FOUND)


def _shared_words(nodes: DataFrame, name: str) -> DataFrame:
    """(node, name) of nodes(node, lo, hi): the words that all contexts between the two begin with."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [_common(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["node", name])

    return nodes.select("node", "lo", "hi").mapInArrow(rows, f"node bigint, {name} int")


def _with_next(rows: DataFrame, side: str, depth: str, name: str) -> DataFrame:
    """rows with the hash of the word after the first `depth` words of their context `side`."""
    at = [rows.columns.index(c) for c in (side, depth, "cid", "pos")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "left"):
                found = [_next_word(*x) for x in zip(*(part.column(i).to_pylist() for i in at))]
                yield part.append_column(name, pa.array(found, pa.int64()))

    return rows.mapInArrow(add, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, {name} bigint")


def split_hot(rows: DataFrame, window: int, min_words: int, hot_rows: int, piece: int) -> DataFrame:
    """_FOUND of rows(_CONTEXTS) whose nodes are each too large for a task."""
    out, gram = [], min_words - window + 1
    down = lambda x, y: F.xxhash64(x, y)

    def sized(df: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """Rows of the nodes of two rows to hot_rows, those of the larger ones, and whether there are any."""
        n = df.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        df = cut(df.join(n, "node"))
        return df.where(F.col("n") <= hot_rows).drop("n"), df.where(F.col("n") > hot_rows).drop("n"), df.agg(F.max("n")).first()[0] is not None

    def any_row(df: DataFrame) -> bool:
        return bool(df.limit(1).count())

    hot = rows.dropDuplicates(["node", "cid", "pos"])  # a row of the table that came twice
    while True:
        ends = hot.groupBy("node").agg(F.min("right").alias("lo"), F.max("right").alias("hi"))
        hot = cut(_with_next(hot.join(_shared_words(ends, "r"), "node"), "right", "r", "child"))
        wide = hot.where((F.col("r") + window - 1 >= min_words) & ((F.col("reign") >= 0) | (F.col("r") > gram))).drop("right")
        while any_row(wide):
            ends = wide.groupBy("node").agg(F.min("left").alias("lo"), F.max("left").alias("hi"), F.min("child").alias("c0"), F.max("child").alias("c1"), F.min(F.struct("cid", "pos")).alias("least"), F.count("*").alias("n"))
            ends = cut(ends)
            wide = cut(_with_next(wide.join(ends.select("node", "c0", "c1", "least", "n"), "node").join(_shared_words(ends, "l"), "node"), "left", "l", "before"))
            reports = F.expr(  # as _reports()
                f"if(reign < 0, l <= -reign div {window} and {window - 1} - l <= -reign % {window} and r > {gram}, l <= reign div {window} % {window}"
                f" and {window - 1} - l <= reign % {window} and (l > 0 or reign < {window * window} or r <= reign div {window * window} + {gram}))"
            )
            out.append(
                wide.where((F.col("l") + F.col("r") >= min_words) & (F.col("c0") != F.col("c1")) & reports)
                .selectExpr("least.cid least_cid", "least.pos - l least_start", "l + r n_words", "n n_occurrences", f"cast(pmod(xxhash64(cid, pos), ceil(n / {piece})) as int) part", "struct(doc_id, pos - l as start) o")
                .groupBy("least_cid", "least_start", "n_words", "n_occurrences", "part")
                .agg(F.array_sort(F.collect_list("o")).alias("o"))  # about `piece` of them
                .select("least_cid", "least_start", "n_words", "n_occurrences", "part", F.col("o.doc_id").alias("doc_ids"), F.col("o.start").alias("starts"))
            )
            deeper = wide.where(f"l + 1 < {window} or l < -reign div {window}").withColumn("node", down("node", "before")).drop("c0", "c1", "least", "n", "l", "before")
            small, wide, more = sized(deeper)
            if not more:
                break
            out.append(left_trees(small, window, min_words, piece))
        small, hot, more = sized(hot.withColumn("node", down("node", "child")).drop("child", "r"))
        if more:
            out.append(trees(small.select(*rows.columns), window, min_words, piece))
        if not more or not any_row(hot):
            return reduce(DataFrame.union, out)


def maximal_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot_rows: int = HOT_ROWS, piece: int = PIECE) -> DataFrame:
    """(repeat_id, n_words, n_occurrences, part, doc_ids, starts): starts are places of first words, beside their documents."""
    window = min_words - gram + 1
    src = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("cid"), "text")
    members = src.select("cid", "doc_id", F.regexp_count("text", F.lit(r"[^ \t\n\x0b\f\r]+")).cast("int").alias("n_words")).distinct()
    marks = anchors(src.select("cid", "text"), min_words, gram)
    place = F.xxhash64("cid", "pos")
    shared = cut(
        marks.groupBy("g")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min("left").alias("c"), F.max("left").alias("d"), F.count("*").alias("n"))
        .where("a <> b")
        .select("g", ((F.col("c") != F.col("d")).cast("int") * F.when(F.col("n") > hot_rows, 3).otherwise(1)).alias("kind"))  # 0: the left never differs; 3: hot
    )
    by_text = cut(marks.select("g", "cid", "pos").join(shared, "g").groupBy("cid").agg(F.collect_set(F.col("pos") * 4 + F.col("kind")).alias("marks")).where(F.exists("marks", lambda m: m % 4 > 0)))
    owners = members.groupBy("cid").agg(F.min("doc_id").alias("doc_id"))

    def suffixes(kind: int) -> DataFrame:
        """_CONTEXTS of the anchors of this kind."""

        def context_batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _CONTEXTS.split(", ")])

        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found = words(part.column(1), VERBATIM)
                    at, g, spans, reigns = select_anchors(found.first, found.hashes(), gram, window)
                    bounds = np.searchsorted(at, found.first)
                    rows, size = [], 0
                    for i, (cid, text, marks, doc) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)))):
                        w = _text_words(text)
                        known = {m // 4: m % 4 for m in marks}
                        a, b = bounds[i], bounds[i + 1]
                        reach, follow = len(w), -1
                        for pos, gram_hash, span, reign in zip((at[a:b] - found.first[i]).tolist()[::-1], g[a:b].view(np.int64).tolist()[::-1], spans[a:b].tolist()[::-1], reigns[a:b].tolist()[::-1]):
                            if pos in known:
                                if follow < 0:
                                    reach = len(w)
                                elif follow not in known:
                                    reach = min(len(w), follow + window + gram - 1)
                                if known[pos] == kind:
                                    rows.append((gram_hash, cid, pos, b"\0".join(w[max(0, pos - max(window, 1 - span)) : pos][::-1]), b"\0".join(w[pos:reach]), reign, doc))
                                    size += len(rows[-1][3]) + len(rows[-1][4])
                                    if size > SLICE_BYTES:
                                        yield context_batch(rows)
                                        rows, size = [], 0
                            follow = pos
                    if rows:
                        yield context_batch(rows)

        holders = by_text.where(F.exists("marks", lambda m: m % 4 == kind)).join(owners, "cid")
        return src.join(holders.hint("shuffle_hash"), ["doc_id", "cid"]).select("cid", "text", "marks", "doc_id").mapInArrow(contexts, _CONTEXTS)

    found = trees(suffixes(1), window, min_words, piece)
    if shared.where("kind = 3").limit(1).count():
        found = found.union(split_hot(cut(suffixes(3)), window, min_words, hot_rows, piece))
    # a class of equal texts is a repeat itself, from end to end
    sizes = cut(members.groupBy("cid").agg(F.count("*").alias("n_occurrences"), F.max("n_words").alias("n_words")).where((F.col("n_occurrences") > 1) & (F.col("n_words") >= min_words)))
    classes = (
        members.select("cid", "doc_id")
        .join(sizes, "cid")
        .withColumn("part", F.expr(f"cast(pmod(xxhash64(doc_id), ceil(n_occurrences / {piece})) as int)"))
        .groupBy("cid", "n_words", "n_occurrences", "part")
        .agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))  # about `piece` of them
        .select(F.xxhash64("cid").alias("repeat_id"), "n_words", "n_occurrences", "part", "doc_ids", F.expr("transform(doc_ids, d -> 0)").alias("starts"))
    )
    return found.select(F.xxhash64("least_cid", "least_start", "n_words").alias("repeat_id"), "n_words", "n_occurrences", "part", "doc_ids", "starts").union(classes)


def occurrences(repeats: DataFrame) -> DataFrame:
    """(repeat_id, n_words, n_occurrences, doc_id, start) of maximal_repeats(): a row for each occurrence, made in the task that holds its piece."""
    return repeats.select("repeat_id", "n_words", "n_occurrences", F.inline(F.arrays_zip("doc_ids", "starts")).alias("doc_id", "start"))
