"""The registered queries of operators 1, 2, 4 and 10 over a small folder, against plain versions that share no code with them."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from sparkloom.llm import arrowtext, chunks, quality, queries, secrets, simhash, toxicity, vocab
from tests.llm.test_llm_operators import prose

M = (1 << 64) - 1


# plain versions ------------------------------------------------------------------


def spans_of(docs: dict[int, str]) -> set:
    """(doc_id, start, end, chunks, owners), chunk by chunk, comparing the bytes themselves."""
    pieces: dict[bytes, list] = {}
    for d, text in docs.items():
        raw, h, hits = text.encode(), 0, []
        for i, b in enumerate(raw):
            h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
            if (h >> 8) & 31 == 0:
                hits.append(i + 1)
        cuts = [c for k, c in enumerate(hits) if k == 0 or c - hits[k - 1] >= chunks.MIN_BYTES]
        at = 0
        for c in sorted({*cuts, len(raw)} - {0}):
            while at < c:
                to = min(at + chunks.MAX_BYTES, c)
                pieces.setdefault(raw[at:to], []).append((d, xxhash.xxh3_64_intdigest(raw) & 0x7FFFFFFF, at, to))
                at = to
    again = sorted((d, t, a, b, min(places)[0]) for places in pieces.values() for d, t, a, b in set(places) if (d, t, a, b) != min(places))
    out, run = set(), []
    for row in [*again, None]:
        if run and (row is None or row[:2] != run[-1][:2] or row[2] != run[-1][3]):
            if run[-1][3] - run[0][2] >= chunks.MIN_SPAN:
                out.add((run[0][0], run[0][2], run[-1][3], len(run), tuple(sorted({r[4] for r in run}))))
            run = []
        run.append(row)
    return out


LETTERS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}


def distance(said: str, term: str) -> int:
    """Edits between the two; a digit is also each of its letters."""
    row = list(range(len(term) + 1))
    for i, x in enumerate(said, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(term, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y and y not in LETTERS.get(x, "")))
    return row[-1]


def weight_of(token: str, terms) -> tuple[float, str] | None:
    forms = [token, *re.findall(r"[^\W\d_]+", token)] if re.search(r"\d", token) else [token]
    best = None
    for form in forms:
        for term in terms:
            n = len(term)
            if abs(len(form) - n) < 3 and (e := distance(form, term)) <= (0 if n < 5 else 1 if n < 9 else 2):
                w = (1.0, 0.5 if n >= 7 else 0.25, 0.25)[e]
                best = max(best or (0, ""), (w, term))
    return best


def toxicity_of(text: str, terms) -> float:
    low, quoted, open_at = text.lower(), [False] * len(text), None
    for i, c in enumerate(low):
        if c == "\n":
            open_at = None
        elif c == '"' and open_at is None:
            open_at = i
        elif c == '"':
            quoted[open_at : i + 1] = [True] * (i + 1 - open_at)
            open_at = None
    tokens = list(re.finditer(r"\d*[^\W\d_][^\W_]*", low))
    hits = []
    for k, m in enumerate(tokens):
        w = weight_of(m.group(), terms)
        if w:
            reported = any(t.group() in toxicity.REPORTING for t in tokens[max(0, k - 4) : k])
            hits.append((k, w[0] * (toxicity.QUOTED if quoted[m.start()] or reported else 1), m.group() if w[0] < 1 else None))
    best = 0.0
    for k, *_ in hits:
        window = [h for h in hits if k - 2 * toxicity.WINDOW <= h[0] <= k]
        forms = {f for *_, f in window if f}
        best = max(best, sum(w for _, w, f in window if f is None) + sum(max(w for _, w, g in window if g == f) for f in forms))
    return best


def secrets_of(text: str) -> list[tuple[int, int]]:
    """Runs that stand alone, by the ratio of the whole run."""
    enc, out = vocab.encoding(vocab.DEFAULT_VOCAB), []
    for m in re.finditer(r"[A-Za-z0-9+/_\-]{20,}={0,2}", text):
        s = m.group()
        if not re.search("[A-Za-z]", s) or not re.search(r"\d", s):
            continue
        led = re.search(r"(?i)(token|secret|password|api_key)[\"']?\s*[=:]?\s*[\"']?$", text[: m.start()])
        if not led and (re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", s) or s.count("-") == 4):
            continue
        if len(s) < secrets.MAX_RATIO * len(enc.encode_ordinary(s)):
            out.append(m.span())
    return out


def mixed(h: int) -> int:
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & M
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M
    return h ^ h >> 31


def print_of(text: str) -> tuple[int, ...] | None:
    """The 256 bits of a text, word by word and bit by bit."""
    found = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())
    if not found:
        return None
    out = []
    hashes = {w: mixed(sum(int(arrowtext._BYTE[b]) * pow(arrowtext._BASE, k, 1 << 64) for k, b in enumerate(w)) & M) for w in set(found)}
    weights = {w: round(4 * (1 + math.log(found.count(w))) * (min(len(w), 8) - 0.5)) for w in hashes}
    for k in (1, 2, 3, 4):
        bits = 0
        for i in range(64):
            one = sum(weights[w] for w, h in hashes.items() if mixed(h + 0x9E3779B97F4A7C15 * k & M) >> i & 1)
            bits |= (2 * one > sum(weights.values())) << i
        out.append(bits)
    return tuple(out)


# the queries over a folder ----------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    d = tmp_path_factory.mktemp("brute")
    passage = prose(rng, 70)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    docs = [(i, prose(rng, rng.randrange(3, 90))) for i in range(120)]
    docs += [(200 + i, f"{prose(rng, rng.randrange(1, 30))} {passage} {prose(rng, rng.randrange(1, 30))}") for i in range(8)]
    longest = max(docs[:120], key=lambda r: len(r[1]))[1]
    docs += [(300, longest), (301, "ab " * 400), (302, "x ab " * 300), (303, "ö" * 900), (303, longest), (None, passage), (304, None), (305, "")]
    long = " ".join(["calm words"] * 60)
    abuse = ["you idiot", "m0ron", "1d10t here", "such worthlless people", "worthlles scum", f'he said "{long} you idiot {long}"', f'"idiot" {long}', "p4thetic tra5h", "stupid2", "what a cl0wn and looser", "dizgusting mess", "disgustign disgusitng", "10537 numbers", "she called them trash", "bastardd bastardd"]
    docs += [(400 + i, f"{prose(rng, 12)} {a} {prose(rng, 12)}") for i, a in enumerate(abuse)]
    docs += [(500, f"token = {hexes(40)} end"), (501, f"token =\n{' ' * 60}{hexes(40)}"), (502, f"commit {hexes(40)}"), (503, f"key Kq7Zt2LmX9vB4nRw8Yh3Jd6Pf1s {hexes(64)}"), (504, "123e4567-e89b-12d3-a456-426614174000"), (505, "internationalization_settings_page2"), (506, f"x{'1234567890' * 4}")]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(100)] + [(None, 1, 1), (400, None, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs, labels


def test_op1(spark, folder):
    d, docs, _ = folder
    known = {i: t for i, t in docs if i is not None and i != 303}
    got = {(r["doc_id"], r["byte_start"], r["byte_end"], r["n_chunks"], tuple(r["source_doc_ids"])) for r in queries.op1_substring_dedup(spark, d).collect()}
    # 303 has two texts: its own rows are apart, and no other document owns less for it
    assert {x for x in got if x[0] != 303} == {x for x in spans_of({k: t or "" for k, t in known.items()}) if x[0] != 303}
    assert {207, 300, 303} <= {x[0] for x in got}


def test_op2(spark, folder):
    d, docs, _ = folder
    got = {r["doc_id"]: r["toxicity"] for r in queries.op2_toxicity(spark, d).collect()}
    want = {i: s for i, t in docs if (s := round(toxicity_of(t or "", toxicity.SEEDS), 6)) >= toxicity.THRESHOLD}
    assert got == want and len(want) >= 6


def test_op4(spark, folder):
    d, docs, labels = folder

    def features(text: str) -> list[float]:
        raw = text.encode()
        w = re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw)
        n = max(len(w), 1)
        kind = lambda c: (1 if c >= 128 or chr(c).islower() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 4 if chr(c).isspace() else 5 if chr(c) in ".,;:!?'\"-()" else 6 if 32 < c < 127 else 0)
        kinds = [kind(c) for c in raw]
        size = max(len(raw), 1)
        return [math.log1p(len(w)), sum(map(len, w)) / n, sum(len(x) <= 3 for x in w) / n, sum(len(x) >= 12 for x in w) / n, len(set(w)) / n * math.log1p(len(w)), sum(a == b for a, b in zip(w, w[1:])) / n,
                kinds.count(6) / size, kinds.count(5) / n, kinds.count(3) / size, kinds.count(2) / n, math.log1p(len(w) / (raw.count(b"\n") + 1))]

    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    taught = sorted((q, features(texts[i])) for i, q, _ in labels if i is not None and q is not None and re.search(r"\w", texts[i] or ""))
    ranking = quality.fit_pairs(np.array([x for _, x in taught]), np.array([q > 0 for q, _ in taught]))
    scores = [(i, round(float(ranking.score(np.array([features(t)]))[0]), 9)) for i, t in docs if t and re.search(r"[A-Za-z0-9\x80-\xff]", t)]
    ordered = sorted(s for _, s in scores)
    least = ordered[max(math.ceil(ranking.bad_share * len(ordered)) - 1, 0)]
    got = sorted(((r["doc_id"], round(r["score"], 6)) for r in queries.op4_quality(spark, d).collect()), key=repr)
    assert got == sorted(((i, round(s, 6)) for i, s in scores if s >= least), key=repr)  # those of the threshold itself stay
    assert 0 < len(got) < len(scores)


def test_op10(spark, folder):
    d, docs, _ = folder
    got = sorted(((r["doc_id"], r["char_start"], r["char_start"] + r["n_chars"], r["value_sha256"]) for r in queries.op10_secrets(spark, d).collect()), key=repr)
    want = sorted(((i, a, b, hashlib.sha256(t[a:b].encode()).hexdigest()) for i, t in docs for a, b in secrets_of(t or "")), key=repr)
    assert got == want and {x[0] for x in got} == {500, 501, 503, 506}


def test_fingerprints_bit_by_bit(spark):
    rng = random.Random(32)
    texts = [prose(rng, n) for n in (1, 2, 9, 60)] + ["Ünï çode, words. Words again words", "a a a b"]
    rows = {r["doc_id"]: r for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][f] & M for f in ("f0", "f1", "f2", "f3")) == print_of(t)


def test_limits_that_are_no_more():
    enc = vocab.encoding(vocab.DEFAULT_VOCAB)
    short = secrets.find("key q9Zx7Lm2Vb4N end", enc, 12, secrets.MAX_RATIO, frozenset())
    assert [x[:2] for x in short] == [(4, 16)] and not secrets.find("key q9Zx7Lm2Vb4N end", enc, 20, secrets.MAX_RATIO, frozenset())
    auto = toxicity.LexiconAutomaton((toxicity.SEEDS, (), ()))
    score = lambda t: (toxicity.judge(t, auto.match, {}, toxicity.WINDOW, toxicity.QUOTED) or (0,))[0]
    for n in (10, 300, 500, 5000):
        assert score(f'"{"x " * n}you idiot"') == toxicity.QUOTED and score(f'"{"x " * n}\nyou idiot"') == 1
    assert toxicity.quotations("«a “b” c» „d“ \"e\" “f") == [(0, 9), (10, 13), (14, 17)]
