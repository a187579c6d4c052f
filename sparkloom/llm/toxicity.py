"""Operator 2. Toxicity by a fuzzy lexicon and context windows.

The lexicon is a trie of words (no edit below five letters, one up to eight, two
from nine on; a digit counts as the letter it is written for, as in "m0ron") and of stems
(any continuation counts). Levenshtein automata of all words are intersected
with the trie and determinised lazily, so a word is judged by walking one
transition per character, and most words die within a few. Around every hit a
window of tokens is summed: an exact hit counts 1, a misspelt one less, and one
that stands in quotation marks or after a reporting word counts `quoted` of
that, so quoting abuse alone stays below the threshold. A quotation is whatever
stands between a pair of marks in one line, however long.

Beside the given words the lexicon is learned from at most `max_labelled`
labelled documents (the least by hash of doc_id, so the choice is the same at
any partitioning): words and stems that occur in toxic documents of many
different word-set signatures and in almost no clean one. Stems have four letters to
`max_stem`. A signature is made of
the four least word hashes of a document; near copies share it and count once. Stems that
are `min_lift` times as frequent in toxic documents as in clean ones, but do
occur in clean ones, are weak: a hit counts `WEAK`, and a form of the word that
comes again in the window counts once, by its largest weight, so one such word
alone accuses nobody.

Defined cases: null or empty text is not toxic; null doc_id is carried; a
repeated row is judged each time; conflicting labels count as toxic; null labels
are ignored; other columns are not touched; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut

from .arrowtext import slices

SEEDS = ("loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid", "imbecile", "bastard", "scumbag", "retard")
REPORTING = frozenset("said says wrote writes quote quoted quotes called calls term word phrase insult dit écrit sagte schrieb dijo escribió".split())
WINDOW = 12
THRESHOLD = 1.0
QUOTED = 0.2
MAX_LABELLED = 6_000
MIN_SUPPORT = 8
MAX_CLEAN = 0.02
MIN_LIFT = 4.0
WEAK = 0.5
MAX_STEM = 8
VERDICT = "doc_id bigint, toxicity double, n_hits int, n_quoted int, terms array<string>, toxic boolean"

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\d*[^\W\d_][^\W_]*")  # letters, with digits among them
_MARKS = re.compile(r'["“”„«»\n]')
#: Letters that a digit is written for.
_WRITTEN_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: words, stems, weak stems (may be left out)
Lexicon = tuple[tuple[str, ...], ...]


class LexiconAutomaton:
    """Trie of the lexicon intersected with Levenshtein automata, determinised as words need it."""

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.weak: dict[int, str] = {}
        self.allow: list[int] = [0]
        for term in lexicon[0]:
            self._add(term, self.word, self.allow_of(term))
        for term in lexicon[1]:
            self._add(term, self.stem, 0)
        for term in lexicon[2] if len(lexicon) > 2 else ():
            self._add(term, self.weak, 0)
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[str, float] | None] = []
        self.absorbing: list[bool] = []
        self.items: list[frozenset] = []
        self.start = self._state({(0, 0, False)})

    def _add(self, term: str, kind: dict[int, str], allow: int) -> None:
        node = 0
        for c in term:
            self.allow[node] = max(self.allow[node], allow)
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.allow.append(0)
            node = self.children[node][c]
        self.allow[node] = max(self.allow[node], allow)
        kind[node] = term

    def _state(self, items: set[tuple[int, int, bool]]) -> int:
        """The state of (node of the trie, edits so far, whether a digit stood for a letter)."""
        todo = list(items)
        while todo:  # a character of the lexicon left out
            node, e, digit = todo.pop()
            for child in self.children[node].values():
                if e < self.allow[child] and (child, e + 1, digit) not in items:
                    items.add((child, e + 1, digit))
                    todo.append((child, e + 1, digit))
        key = frozenset(items)
        if key in self.ids:
            return self.ids[key]
        best: tuple[str, float] | None = None
        absorbing = False
        for node, e, digit in key:
            if e == 0 and not digit and (node in self.stem or node in self.weak):
                best, absorbing = ((self.stem[node], 1.0) if node in self.stem else (self.weak[node], WEAK)), True
                break
            if node in self.word and e <= self.allow_of(self.word[node]):
                term = self.word[node]
                weight = (1.0, 0.5 if len(term) >= 7 else 0.25, 0.25)[e]
                if best is None or (weight, term) > (best[1], best[0]):
                    best = (term, weight)
        self.ids[key] = len(self.items)
        self.items.append(key)
        self.moves.append({})
        self.accept.append(best)
        self.absorbing.append(absorbing)
        return len(self.items) - 1

    @staticmethod
    def allow_of(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _step(self, state: int, c: str) -> int:
        out = set()
        letters = _WRITTEN_FOR.get(c, "")
        for node, e, digit in self.items[state]:
            for ch, child in self.children[node].items():
                if ch == c:
                    out.add((child, e, digit))
                elif ch in letters:
                    out.add((child, e, True))
                elif e < self.allow[child]:
                    out.add((child, e + 1, digit))
            if e < self.allow[node]:
                out.add((node, e + 1, digit))
        to = self._state(out) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, token: str) -> tuple[str, float] | None:
        """(term, weight) of the token as it stands, or of its letters between digits, whichever weighs more."""
        found = self._walk(token)
        if found is None or found[1] < 1:
            for part in _WORD.findall(token) if not token.isalpha() else ():
                other = self._walk(part)
                if other and (found is None or other[1] > found[1]):
                    found = other
        return found

    def _walk(self, word: str) -> tuple[str, float] | None:
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
            if self.absorbing[state]:
                break
        return self.accept[state]


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between paired quotation marks of one line, in order and apart."""
    spans: list[tuple[int, int]] = []
    opened: dict[str, int] = {}
    for m in _MARKS.finditer(text):
        c, at = m.group(), m.start()
        if c == "\n":
            opened.clear()
            continue
        pair = next((o for o in {'"': '"', "”": "“„", "“": "„", "»": "«"}.get(c, "") if o in opened), None)
        if pair:
            spans.append((opened.pop(pair), at + 1))
        elif c in '"“„«':
            opened.setdefault(c, at)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def judge(text: str, match, memo: dict, window: int, quoted: float) -> tuple[float, int, int, list[str]] | None:
    """(highest window sum, hits, quoted hits, terms) of one text; None without a hit."""
    low = text.lower()
    found = _TOKEN.findall(low)
    hit = False
    for w in set(found):
        if w in memo:
            hit = hit or memo[w] is not None
        else:
            memo[w] = m = match(w)
            hit = hit or m is not None
    if not hit:
        return None
    spans = quotations(low)
    hits, terms, n_quoted = [], set(), 0
    guessed: set[str] = set()  # a misspelling or a weak hit that comes again is a word of the text, and counts once a window
    at = 0
    for i, m in enumerate(_TOKEN.finditer(low)):
        x = memo[m.group()]
        if x is None:
            continue
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        in_quotes = at < len(spans) and spans[at][0] <= m.start()
        reported = any(w in REPORTING for w in found[max(0, i - 4) : i])
        n_quoted += in_quotes or reported
        if x[1] < 1:
            guessed.add(m.group())
        hits.append((i, x[1] * (quoted if in_quotes or reported else 1.0), m.group() if x[1] < 1 else None))
        terms.add(x[0])
    best, left, total = 0.0, 0, 0.0
    inside: dict[str, Counter] = {}  # the weights of each guessed form in the window

    def move(form: str | None, weight: float, by: int) -> float:
        """What the window's sum changes by when a hit comes in (1) or goes out (-1)."""
        if form is None:
            return by * weight
        mine = inside.setdefault(form, Counter())
        before = max(mine, default=0.0)
        mine[weight] += by
        if not mine[weight]:
            del mine[weight]
        return max(mine, default=0.0) - before

    for i, weight, form in hits:
        total += move(form, weight, 1)
        while hits[left][0] < i - 2 * window:
            total += move(hits[left][2], hits[left][1], -1)
            left += 1
        best = max(best, total)
    return round(best, 6), sum(h[2] is None for h in hits) + len(guessed), n_quoted, sorted(terms)


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame | None,
    seeds: tuple[str, ...] = SEEDS,
    max_labelled: int = MAX_LABELLED,
    min_support: int = MIN_SUPPORT,
    max_clean: float = MAX_CLEAN,
    min_lift: float = MIN_LIFT,
    max_stem: int = MAX_STEM,
) -> Lexicon:
    """(words, stems, weak stems): the seeds and what the labelled documents teach."""
    if labels is None:
        return tuple(sorted(seeds)), (), ()
    sample = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    ids = F.broadcast(sample)  # at most max_labelled rows of two numbers
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, bool, int], int] = {}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(_WORD.findall(text.lower()))
                if not found:
                    continue
                sig = hash(tuple(nsmallest(4, (crc32(w.encode("utf-8", "replace")) for w in found))))
                for w in found:
                    for k in range(4, min(max_stem, len(w)) + 1):
                        key = w[:k], False, sig
                        rows[key] = max(toxic, rows.get(key, 0))
                    if len(w) >= 4:
                        key = w, True, sig
                        rows[key] = max(toxic, rows.get(key, 0))
            if rows:
                term, whole, sig = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(whole), pa.array(sig, pa.int64()), pa.array(list(rows.values()), pa.int32())], ["term", "whole", "sig", "toxic"])

    read = texts.join(ids, "doc_id").select(F.col("toxic").cast("int"), "text").mapInArrow(terms, "term string, whole boolean, sig bigint, toxic int")
    per_text = cut(read.groupBy("term", "whole", "sig").agg(F.max("toxic").alias("toxic")))  # it's read twice
    every = per_text.groupBy("sig").agg(F.max("toxic").alias("toxic")).agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    clean, share = max(every["n"] - every["bad"], 1), every["bad"] / max(every["n"] - every["bad"], 1)
    counted = per_text.groupBy("term", "whole").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(F.col("bad") >= min_support)
    pure = F.col("n") - F.col("bad") <= max_clean * F.col("n")
    # half a clean text is added, so that a few toxic ones alone don't make a lift
    lifted = ~F.col("whole") & (F.col("bad") >= min_lift * share * (F.col("n") - F.col("bad") + 0.5)) & (F.length("term") >= 4) & F.lit(clean > 1)
    # the terms of a lexicon: as many as language has such words
    rows = counted.select("term", "whole", "bad", "n", pure.alias("pure"), lifted.alias("lifted")).where("pure or lifted").collect()
    strong = {r["term"]: r["bad"] for r in rows if not r["whole"] and r["pure"]}
    lift = {r["term"]: (r["bad"], r["n"]) for r in rows if not r["whole"] and r["lifted"]}
    words_found = {r["term"]: r["bad"] for r in rows if r["whole"] and r["pure"]}
    # the shortest lifted stem with what follows it always; below it all is weak unless the stem itself is strong
    weak = set()
    for p in [p for p in lift if p[:-1] not in lift and p not in strong]:
        while longer := [q for q in lift if len(q) == len(p) + 1 and q.startswith(p) and lift[q] == lift[p]]:
            p = longer[0]
        if p not in strong and not any(w.startswith(p) for w in seeds):
            weak.add(p)
    stems = {p: n for p, n in strong.items() if not any(p.startswith(x) for x in weak)}
    least = [p for p in stems if p[:-1] not in stems]
    out_words, out_stems = set(seeds), set()
    for p in least:
        main = [w for w, bad in words_found.items() if w.startswith(p) and bad >= 0.8 * stems[p]]
        if main:
            out_words.add(max(main, key=lambda w: (words_found[w], len(w), w)))
        else:
            out_stems.add(p)
    return tuple(sorted(out_words)), tuple(sorted(out_stems)), tuple(sorted(weak))


_made: dict[Lexicon, tuple[LexiconAutomaton, dict]] = {}


def _automaton(lexicon: Lexicon) -> tuple[LexiconAutomaton, dict]:
    if lexicon not in _made:
        _made.clear()
        _made[lexicon] = LexiconAutomaton(lexicon), {}
    automaton, memo = _made[lexicon]
    if len(memo) > 400_000:
        memo.clear()
    return automaton, memo


def score_toxicity(docs: DataFrame, lexicon: Lexicon, window: int = WINDOW, quoted: float = QUOTED, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document with a hit; `toxic` says whether its highest window reaches the threshold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in slices(batch):
                automaton, memo = _automaton(lexicon)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text and (x := judge(text, automaton.match, memo, window, quoted)):
                        rows.append((doc, *x, x[0] >= threshold))
            if rows:
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_())
                names = [x.split()[0] for x in VERDICT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(score, VERDICT)


def reject_toxic(docs: DataFrame, lexicon: Lexicon, window: int = WINDOW, quoted: float = QUOTED, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the toxic ones; columns and other rows stay as they are."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                automaton, memo = _automaton(lexicon)
                ok = []
                for text in part.column(at).to_pylist():
                    x = judge(text, automaton.match, memo, window, quoted) if text else None
                    ok.append(x is None or x[0] < threshold)
                yield part.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
