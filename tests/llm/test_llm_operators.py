from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import regex

from sparkloom.llm import bpe, chunks, decontaminate, permutation, quality, repeats, secrets, simhash, toxicity, urls, vocab

DOC = "doc_id bigint, text string"
ODD = "doc_id bigint, text string, n_chars bigint, digest string, key int, g string, label int"


def prose(rng: random.Random, n: int, size: int = 4000) -> str:
    return " ".join(f"{rng.choice('bcdfgklmn')}{rng.choice('aeiou')}{rng.randrange(size):x}"[:9].translate(str.maketrans("0123456789", "qwrtzpsxvj")) for _ in range(n))


def odd_rows(rng):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns."""
    long = prose(rng, 12_000)
    row = (7, "a plain text of a few words", 27, "d", 1, "x", None)
    return [row, row, (None, "text without a number", None, None, None, None, None), (8, None, 0, "d", 2, None, 1), (9, "", 0, None, None, None, None), (10, " \n\t ", 4, None, None, "", 0), (11, long, len(long), "d", 3, "x", 1), (12, "Ünïcode “quoted” 日本語 🙂", 20, "d", 4, "y", 0)]


# --- 1 ---


def test_cuts_cover_texts_and_resist_shifts():
    import pyarrow as pa

    from sparkloom.llm.arrowtext import text_bytes

    rng = random.Random(1)
    passage = prose(rng, 200)
    texts = [passage, "shifted by this " + passage, "", prose(rng, 5)]
    b = text_bytes(pa.array(texts))
    starts, ends = chunks.cuts(b)
    assert starts.tolist() == [0, *ends.tolist()[:-1]] and ends[-1] == len(b.data)
    assert (ends - starts).max() <= chunks.MAX_BYTES
    assert set(b.offs.tolist()) <= {0, *ends.tolist()}
    pieces = [bytes(b.data[x:y]) for x, y in zip(starts, ends)]
    first = [p for p, s in zip(pieces, starts) if s < b.offs[1]]
    second = [p for p, s in zip(pieces, starts) if b.offs[1] <= s < b.offs[2]]
    assert len(set(first) & set(second)) >= len(set(first)) - 3


def test_gear_is_the_rolling_definition():
    import pyarrow as pa

    from sparkloom.llm.arrowtext import text_bytes

    b = text_bytes(pa.array(["hello wörld, rolled over bytes one at a time", "x", "", "again"]))
    got, want = chunks.gear_hashes(b), []
    for i in range(len(b.offs) - 1):
        h = 0
        for c in b.data[b.offs[i] : b.offs[i + 1]].tolist():
            h = ((h << 1) + int(chunks._GEAR[c])) & 0xFFFFFFFF
            want.append(h)
    assert got.tolist() == want


def test_spans_are_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, 80)) for i in range(20)]
    docs += [(100 + i, f"{prose(rng, 30 + i)} {passage} {prose(rng, 25)}") for i in range(6)]
    docs += [(200, docs[3][1])]
    rows = chunks.repeated_spans(spark.createDataFrame(docs, DOC).repartition(3)).collect()
    assert {r["doc_id"] for r in rows} == {200, *range(101, 106)}
    assert all(r["source_doc_ids"] == [100] for r in rows if r["doc_id"] < 200)
    whole = next(r for r in rows if r["doc_id"] == 200)
    assert (whole["byte_start"], whole["byte_end"], whole["source_doc_ids"]) == (0, len(docs[3][1]), [3])
    for r in rows:
        text = dict(docs)[r["doc_id"]][r["byte_start"] : r["byte_end"]]
        assert text in dict(docs)[r["source_doc_ids"][0]]


# --- 2 ---

LEX = (("idiot", "pathetic", "trash"), ("vequ",))


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(3)
    auto = toxicity.LexiconAutomaton(LEX)
    words = set(LEX[0])
    for t in LEX[0]:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.insert(k, rng.choice("aeit")), lambda: w.pop(k), lambda: w.__setitem__(k, rng.choice("aeit"))])()
            words.add("".join(w))
    for w in words:
        want = min(lev(w, t) for t in LEX[0]) <= 1 or w.startswith("vequ")
        assert (auto.match(w) is not None) == want, w
    assert auto.match("vequaire") == ("vequ", 1.0) and auto.match("idiot") == ("idiot", 1.0)
    assert auto.match("pathetik") == ("pathetic", 0.5)


def test_quotation_is_not_abuse(spark):
    docs = [
        (1, "you are an idiot and everybody knows"),
        (2, 'the critic said "what an idiot" in the review and left it there'),
        (3, "he used the word idiot once in a long calm report"),
        (4, "nothing to see here"),
        (5, "such pathetik trassh you wrote, patheticc trash"),
        (6, "un vequaire dans la rue"),
    ]
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(docs, DOC), LEX).collect()}
    assert {d for d, r in rows.items() if r["toxic"]} == {1, 5, 6}
    assert rows[2]["n_quoted"] == rows[3]["n_quoted"] == 1 and 4 not in rows
    kept = toxicity.reject_toxic(spark.createDataFrame(docs, DOC), LEX)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4}


def test_lexicon_is_learned(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        docs.append((i, prose(rng, 40) + (f" grumbo{'abcdefgh'[i // 5 % 8]}x" if bad else "")))
        labels.append((i, 1, int(bad)))
    rare = "zzcopied"
    docs += [(1000 + k, docs[5][1] + f" {rare}") for k in range(30)]  # copies of one toxic text count once
    labels += [(1000 + k, 1, 1) for k in range(30)] + [(None, 1, 1), (4, 1, None)]
    words, stems, weak = toxicity.learn_lexicon(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), seeds=("idiot",))
    assert words == ("idiot",) and stems == ("grum",) and weak == ()
    assert toxicity.learn_lexicon(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id bigint, toxic int"), seeds=("idiot",)) == (("idiot",), (), ())


# --- 3 ---


def test_bpe_is_the_library_and_comes_back(spark):
    rng = random.Random(5)
    texts = ["", None, "Hello  world\n\n  it's  fine ", "日本語🙂 naïve é", "x" * 3000, "\x00 control \t\t", "1234567 + 89", prose(rng, 5000), "<|endoftext|> stays text"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], DOC).repartition(3)
    out = bpe.encode(docs, block_bytes=2000)
    assert {r["doc_id"] for r in out.collect()} == set(range(len(texts) * 2))
    out = bpe.encode(docs.repartition(5, "text"), block_bytes=2000, buckets=7)
    rows = {r["doc_id"]: r for r in out.collect()}
    enc = vocab.encoding(vocab.DEFAULT_VOCAB)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out).collect()}
    assert len(rows) == len(texts) * 2
    for i, t in enumerate(texts * 2):
        assert rows[i]["token_ids"] == (None if t is None else enc.encode_ordinary(t))
        assert back[i] == t
        assert rows[i]["round_trip"] == (None if t is None else True)


def test_ranks_pack():
    for top in (5, 191, 192, 14_527, 14_528, 14_528 + 7 * 65536 - 1, 14_528 + 7 * 65536, 2_000_000):
        x = np.array([0, 1, top, 3, top, 192], np.uint32)
        assert bpe._unpack(bpe._pack(x)).tolist() == x.tolist()
    assert bpe._unpack(bpe._pack(np.zeros(0, np.uint32))).tolist() == []
    parts = bpe._part(bpe._join([np.arange(5), np.zeros(0, np.uint8), np.array([7], np.uint16)]), [np.int64, np.uint8, np.uint16])
    assert [p.tolist() for p in parts] == [[0, 1, 2, 3, 4], [], [7]]


def test_a_task_numbers_its_words_alike_in_any_order(spark):
    rng = random.Random(20)
    rows = [(i, prose(rng, 30)) for i in range(200)]
    ids = lambda r: sorted((x["doc_id"], tuple(x["token_ids"]), x["round_trip"]) for x in bpe.encode(spark.createDataFrame(r, DOC).coalesce(1), block_bytes=3000).collect())
    enc = vocab.encoding(vocab.DEFAULT_VOCAB)
    assert ids(rows) == ids(rows[::-1]) == [(i, tuple(enc.encode_ordinary(t)), True) for i, t in rows]


def test_decode_of_unknown_ids(spark):
    got = bpe.decode(spark.createDataFrame([(1, [10**6, None, -1]), (2, []), (3, None)], "doc_id bigint, token_ids array<int>")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: "���", 2: "", 3: None}


# --- 4 ---


def test_pairs_are_learned_and_generalise():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    good = x[:, 0] - 2 * x[:, 1] > 0
    r = quality.fit_pairs(x[:400], good[:400])
    s, g = r.score(x[400:]), good[400:]
    auc = (s[g][:, None] > s[~g][None, :]).mean()
    assert auc > 0.97
    flat = quality.fit_pairs(x, np.ones(600, bool))
    assert set(flat.weights) == {0.0} and flat.bad_share == 0.0


def test_low_quality_goes_and_clean_stays(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        docs.append((i, " ".join([rng.choice("abc") * 3] * 40) if bad else prose(rng, 60) + "."))
        if i < 300:
            labels.append((i, int(not bad), 0))
    docs += [(None, prose(rng, 60) + "."), (900, None), (901, ""), (902, " .. ")]
    kept = quality.keep_quality(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {i for i in range(400) if i % 8 == 0} and not ids & {900, 901, 902}
    assert len(ids & {i for i in range(400) if i % 8}) >= 0.97 * 350


# --- 5 ---


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_recall_against_brute_force(spark, spread):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 24))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows = permutation.nearest(df, k=8, n_pivots=64, prefix=12, n_probe=60, shard_rows=256).collect()
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    want = brute(x, 8)
    assert np.mean([len(got.get(i, set()) & set(want[i])) / 8 for i in range(900)]) >= 0.9


def recall_with_production_parameters(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in permutation.nearest(df, ask_every=20).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    assert {len(g) for g in got.values()} == {permutation.K} and set(got) == set(range(0, len(x), 20))
    want = brute(x, permutation.K)
    return np.mean([len(got[i] & set(want[i])) / permutation.K for i in got])


def test_recall_of_rows_that_are_no_pivots(spark):
    assert recall_with_production_parameters(spark, np.random.default_rng(10).normal(size=(3000, 64))) >= 0.95


def test_lonely_vectors_have_neighbours_too(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12, 64))[np.arange(1200) % 12] + 0.05 * rng.normal(size=(1200, 64))
    assert recall_with_production_parameters(spark, np.concatenate([x, rng.normal(size=(4, 64))])) >= 0.9


def test_footrule_is_its_definition():
    rng = np.random.default_rng(9)
    perms = np.array([rng.permutation(20)[:6] for _ in range(40)], np.int32)
    inv = permutation.InvertedFiles(perms, 20)
    for q in perms[:10]:
        place = lambda p: {int(v): i for i, v in enumerate(p)}
        a = place(q)
        want = [sum(abs(a.get(v, 6) - b.get(v, 6)) for v in {*a, *b}) for b in map(place, perms)]
        assert inv.footrule(q).tolist() == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, shard int, v int")
    assert {(r["vec_id"], r["neighbor_id"]) for r in permutation.nearest(df).collect()} == {(1, 2), (2, 1)}
    assert permutation.nearest(df.limit(0)).count() == 0


# --- 6 ---


def page(i, url, link=None, refresh=None):
    head = f"<link href='{link}' rel=canonical />" if link and i % 2 else f'<link rel="canonical" href="{link}">' if link else ""
    head += f"<META content='0; URL={refresh}' http-equiv=Refresh>" if refresh and i % 2 else f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""
    return i, url, f"<html><head>{head}</head></html>"


def test_decisions_reach_aliases_and_allow_wins(spark):
    pages = spark.createDataFrame(
        [
            page(1, "http://www.bad.example/x.html"),
            page(2, "https://mirror.example/a/", refresh="https://bad.example/x"),
            page(3, "https://far.example/b?utm_source=q#top", link="http://mirror.example/a"),
            page(4, "https://other.example/c"),
            page(5, "https://sub.bad.example/ok/page", link="http://allowed.example/"),
            page(6, "https://notbad.example/"),
            page(7, "http://shop.example/goods/1"),
            page(8, "http://shop.example/goodsmore/1"),
            (9, None, None),
            (10, "", "<link rel=canonical href=/relative>"),
        ],
        "page_id bigint, url string, html string",
    )
    rules = urls.rules_table(spark, [("block", "domain", "bad.example"), ("allow", "domain", "allowed.example"), ("block", "prefix", "shop.example/goods"), ("block", "domain", None), ("odd", "domain", "other.example")])
    got = {r["page_id"]: r["decision"] for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "pass", 5: "allow", 6: "pass", 7: "block", 8: "pass", 9: "pass", 10: "pass"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_all_tags_of_a_page_in_any_form(spark):
    rows = [
        (1, "https://x.example/a/b.html?q=1", "<LINK HREF='c.html' REL='canonical'><link rel=stylesheet href=/no><link rel='alternate canonical' href=//y.example/d>"),
        (2, "https://x.example/a/b/", '<meta content="3;url=../up?p=1&amp;r=2" http-equiv="refresh"><link rel="canonical" href="?page=2"><meta name=refresh content="url=/no">'),
        (3, "x.example/z", "<link rel=canonical href=rel>"),
        (4, "https://x.example", '<link rel="canonical" href="mailto:a@b"><link rel="canonical" href=""><link\nrel="canonical"\nhref="/./new">'),
    ]
    got = set(map(tuple, urls.url_edges(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()))
    assert got == {("x.example/a/b.html?q=1", "x.example/a/c"), ("x.example/a/b.html?q=1", "y.example/d"), ("x.example/a/b", "x.example/a/up?p=1&r=2"), ("x.example/a/b", "x.example/a/b/?page=2"), ("x.example", "x.example/new")}


def test_url_sql_agrees(spark, tmp_path):
    import duckdb

    rng = random.Random(10)
    hosts = ["bad.example", "www.bad.example", "m.a.example", "a.example", "b.example", "tionsh.example.net", "ththth.example.org", "blog.ththth.example.org"]
    rows = []
    for i in range(150):
        u = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'x'])}/{rng.randrange(9)}{rng.choice(['', '/', '.html', '?utm_source=f', '#top', '?page=2&ref=x'])}"
        rows.append(page(i, u(), u() if rng.random() < 0.2 else None, u() if rng.random() < 0.2 else None))
    for link in ("/de/1", "2.html", "../x", "./../en/3?page=2", "//bad.example/de/4", "?page=2&amp;x=1", "#top", "mailto:x", ""):
        rows += [page(len(rows), f"https://a.example/en/{len(rows)}/q", link), page(len(rows) + 1, f"https://b.example/{len(rows)}.html?x=1", None, link)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, urls.judge_urls(df, urls.rules_table(spark)).select("page_id", "url", "url_key", "site_group", "decision").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(urls.oracle()).fetchall()) == got


# --- 7 ---


def brute_repeats(texts: dict[int, str], least: int) -> set:
    """Maximal repeats of at least `least` words: (words, occurrences), by definition."""
    toks = {d: t.split() for d, t in texts.items()}
    spots: dict[tuple, list] = {}
    for d, w in toks.items():
        for n in range(least, len(w) + 1):
            for i in range(len(w) - n + 1):
                spots.setdefault(tuple(w[i : i + n]), []).append((d, i))
    out = set()
    for s, occ in spots.items():
        if len(occ) < 2:
            continue
        lefts = {toks[d][i - 1] if i else ("start", d) for d, i in occ}
        rights = {toks[d][i + len(s)] if i + len(s) < len(toks[d]) else ("end", d) for d, i in occ}
        if len(lefts) > 1 and len(rights) > 1:
            out.add((len(s), tuple(sorted(occ))))
    return out


def grouped(df) -> set:
    """{(words, occurrences)}; each repeat comes once, in pieces."""
    out, parts, said = {}, set(), {}
    for r in df.collect():
        assert (r["repeat_id"], r["part"]) not in parts
        parts.add((r["repeat_id"], r["part"]))
        said[r["repeat_id"]] = r["n_occurrences"]
        out.setdefault((r["repeat_id"], r["n_words"]), []).extend(zip(r["doc_ids"], r["starts"]))
    assert all(len(occ) == said[i] for (i, _), occ in out.items())
    return {(n, tuple(sorted(occ))) for (_, n), occ in out.items()}


def test_maximal_repeats_are_all_of_them(spark):
    rng = random.Random(11)
    passages = [prose(rng, n).split() for n in (14, 20, 33)]
    texts = {}
    for d in range(30):
        w = prose(rng, rng.randrange(1, 25)).split()
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 4)
            w += p[a : len(p) - rng.randrange(0, 4)] + prose(rng, rng.randrange(4)).split()
        texts[d] = " ".join(w)
    texts[50] = texts[3] + "\n"
    texts[51] = texts[52] = texts[53] = " ".join(passages[1])
    texts[54] = prose(rng, 30)
    texts[55] = texts[54]
    df = spark.createDataFrame(list(texts.items()), DOC).repartition(3)
    classes = {}
    for d, text in texts.items():
        classes.setdefault(text, []).append(d)
    want = brute_repeats({ds[0]: text for text, ds in classes.items()}, 10)
    want |= {(len(text.split()), tuple((d, 0) for d in ds)) for text, ds in classes.items() if len(ds) > 1 and len(text.split()) >= 10}
    for hot_rows, piece in ((repeats.HOT_ROWS, repeats.PIECE), (6, 3)):  # an anchor of more places than that is split among tasks
        got = grouped(repeats.maximal_repeats(df, min_words=10, gram=4, hot_rows=hot_rows, piece=piece))
        assert got == want, (hot_rows, sorted(got - want), sorted(want - got))


def test_one_passage_in_many_documents(spark):
    rng = random.Random(19)
    passage = prose(rng, 60)
    docs = [(d, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for d in range(5000)]
    df = spark.createDataFrame(docs, DOC)
    got = grouped(repeats.maximal_repeats(df, hot_rows=500))
    assert {(n, tuple(d for d, _ in occ)) for n, occ in got if len(occ) > 50} == {(60, tuple(range(5000)))}
    assert got == grouped(repeats.maximal_repeats(df))


def test_repeats_of_odd_tables(spark):
    rng = random.Random(12)
    p = prose(rng, 60)
    rows = odd_rows(rng) + [(20, p, 1, "", 1, "", 1), (21, prose(rng, 9) + "  " + p, 1, "", 1, "", 1), (None, p, 1, "", 1, "", 1), (22, "in " * 500, 1, "", 1, "", 1)]
    assert grouped(repeats.maximal_repeats(spark.createDataFrame(rows, ODD))) == {(60, ((20, 0), (21, 9)))}
    control = [(1, p.replace(" ", " \x01\x00 ", 30)), (2, "x\x00 " + p.replace(" ", " \x01\x00 ", 30) + " \x01"), (3, prose(rng, 3)), (3, p.replace(" ", " \x01\x00 ", 30) + " \x00")]
    assert {(n, tuple(d for d, _ in occ)) for n, occ in grouped(repeats.maximal_repeats(spark.createDataFrame(control, DOC)))} == {(90, (1, 2, 3))}


def test_query_of_repeats_has_a_row_for_each_occurrence(spark, tmp_path):
    from sparkloom.llm.queries import QUERIES

    rng = random.Random(29)
    p = prose(rng, 60)
    texts = {d: f"{prose(rng, 5 + d)} {p} {prose(rng, 7)}" for d in range(4)}
    texts |= {4: p, 5: prose(rng, 80), 6: prose(rng, 80), 7: f"{p} {prose(rng, 3)} {p}"}
    copies = {8: texts[1], 9: texts[6]}
    many = {d: texts[4] for d in range(100, 100 + repeats.PIECE)}  # more copies than a piece holds
    df = spark.createDataFrame(list((texts | copies | many).items()), DOC)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_maximal_repeats"](spark, str(tmp_path))
    assert got.dtypes == [("repeat_id", "bigint"), ("n_words", "int"), ("n_occurrences", "bigint"), ("doc_id", "bigint"), ("start", "int")]
    rows = [tuple(r)[1:] for r in got.collect()]
    want = brute_repeats(texts, 40)
    for ds in ([1, 8], [6, 9], [4, *many]):
        want.add((len(texts[ds[0]].split()), tuple((d, 0) for d in ds)))
    assert sorted(rows) == sorted((n, len(occ), d, start) for n, occ in want for d, start in occ)
    assert {d for _, _, d, _ in rows} == set(texts) - {5} | set(copies) | set(many)


def test_repeats_that_begin_within_a_run_of_one_word(spark):
    rng = random.Random(31)
    texts = {}
    for d in range(40):
        w = []
        for _ in range(rng.randrange(2, 6)):
            w += [rng.choice(["the", "by", "of"])] * rng.choice([1, 3, 4, 5, 6, 9, 14, 30]) + prose(rng, rng.randrange(3), 3).split()
        texts[d] = " ".join(w) + f" end{d}"
    mixed = lambda found: {(n, occ) for n, occ in found if len(set(texts[occ[0][0]].split()[occ[0][1] : occ[0][1] + n])) > 1}
    want = mixed(brute_repeats(texts, 10))
    assert any(texts[d].split()[at - 1 : at] == texts[d].split()[at : at + 1] for _, occ in want for d, at in occ if at)
    df = spark.createDataFrame(list(texts.items()), DOC).repartition(3)
    for hot_rows in (repeats.HOT_ROWS, 6):
        got = mixed(grouped(repeats.maximal_repeats(df, min_words=10, gram=4, hot_rows=hot_rows)))
        assert got == want, (hot_rows, sorted(got - want)[:5], sorted(want - got)[:5])


# --- 8 ---


def test_suffix_array_matches_are_the_longest(spark):
    rng = random.Random(13)
    items = [prose(rng, n, 30) for n in (5, 9, 20, 30, 3)] + [None, ""]
    docs = []
    for i in range(60):
        w = prose(rng, rng.randrange(1, 40), 30).split()
        if i % 3 == 0:
            p = rng.choice(items[:5]).split()
            a = rng.randrange(0, 3)
            at = rng.randrange(len(w))
            w[at:at] = p[a : len(p) - rng.randrange(3)]
        docs.append((i, " ".join(x.upper() + "," if rng.random() < 0.2 else x for x in w)))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (None, "x"), (102, None), (103, "")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    word = regex.compile(r"[a-z0-9]+").findall
    want = set()
    for d, t in docs:
        for i, q in enumerate(items):
            a, b = word((t or "").lower()), word((q or "").lower())
            need = 6 if len(b) >= 6 else len(b) if len(b) >= 5 else 10**9
            best = None
            for x, y in itertools.product(range(len(a)), range(len(b))):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if n >= need and (best is None or (-n, x, y) < best):
                    best = (-n, x, y)
            if best:
                want.add((d, i, -best[0], best[1], best[2]))
    df = spark.createDataFrame(docs, DOC).repartition(2)
    for shard in (200, 1 << 22):
        got = decontaminate.find_leaks(df, bench, min_words=6, shard_bytes=shard).collect()
        assert {tuple(r) for r in got} == want
    got = decontaminate.find_leaks(df, bench, min_words=6, block_chars=100).collect()
    assert {tuple(r) for r in got} == want
    kept = decontaminate.remove_leaks(df, bench, min_words=6)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in want}
    assert decontaminate.remove_leaks(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0


# --- 9 ---


def near_brute(prints, probe, verify):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        x = [(p ^ q).bit_count() for p, q in zip(prints[a], prints[b])]
        if x[0] <= probe and sum(x) <= verify:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    groups = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    return {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}


def prints_of(df):
    return {r["doc_id"]: tuple(r[f] & (2**64 - 1) for f in ("f0", "f1", "f2", "f3")) for r in simhash.fingerprints(df).collect()}


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(14)
    docs = []
    for k in range(60):
        w = prose(rng, rng.randrange(3, 120), 500).split()
        for c in range(rng.choice([1, 1, 2, 5])):
            v = list(w)
            for _ in range(rng.randrange(0, 1 + len(w) // 12) if c else 0):
                v[rng.randrange(len(v))] = prose(rng, 1, 500)
            docs.append((len(docs), " ".join(v)))
    big = prose(rng, 100, 500).split()
    for _ in range(90):  # one bucket larger than what is compared pair by pair
        v = list(big)
        v[rng.randrange(len(v))] = prose(rng, 1, 500)
        docs.append((len(docs), " ".join(v)))
    df = spark.createDataFrame(docs, DOC).repartition(3)
    prints = prints_of(df)
    for hot_rows in (simhash.HOT_ROWS, 7):  # a bucket of more rows than that is cut into blocks
        got = {tuple(r) for r in simhash.near_groups(df, hot_rows=hot_rows).collect()}
        assert got == near_brute(prints, simhash.PROBE_BITS, simhash.VERIFY_BITS)
        assert len(got) >= 90


def test_a_doc_id_with_two_texts_is_two_documents(spark):
    rng = random.Random(22)
    a, b = prose(rng, 90), prose(rng, 90)
    rows = spark.createDataFrame([(1, a), (7, a), (3, b), (7, b)], DOC)
    assert sorted(map(tuple, simhash.near_groups(rows).collect())) == [(1, 1), (3, 3), (7, 1), (7, 3)]
    assert sorted((r["doc_id"], r["text"] == a) for r in simhash.keep_one(rows).collect()) == [(1, True), (3, False)]
    spans = sorted((r["doc_id"], r["byte_start"], r["byte_end"], tuple(r["source_doc_ids"])) for r in chunks.repeated_spans(rows).collect())
    assert spans == sorted([(7, 0, len(a), (1,)), (7, 0, len(b), (3,))])


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(15)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    for n in (10, 10**5, 10**8, 10**11):
        plan = simhash.allocate(n, x.T @ x * n / 500, 10)
        bits = sorted(b for group, _ in plan for b in group)
        assert len(bits) == len(set(bits))
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        for f in a:
            g = f
            for b in rng.choice(64, 10, replace=False):
                g ^= np.uint64(1) << np.uint64(b)
            k1, k2 = (simhash._keys(np.array([v], np.uint64), plan) for v in (f, g))
            assert any(p[0] == q[0] for p, q in zip(k1, k2))


def test_one_of_each_group_stays(spark):
    rng = random.Random(16)
    text, other = prose(rng, 80), prose(rng, 80)
    rows = [(5, text, 1, "a", 1, "b", 1), (3, text + " tail", 1, "a", 1, "b", 1), (9, text, 1, "a", 1, "b", 1), (4, other, None, None, None, None, None), (4, other, None, None, None, None, None)] + odd_rows(rng)
    kept = simhash.keep_one(spark.createDataFrame(rows, ODD).repartition(2))
    assert kept.columns == [x.split()[0] for x in ODD.split(", ")]
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert [i for i in ids if i in (3, 4, 5, 7)] == [3, 4, 7]
    assert simhash.near_groups(spark.createDataFrame([], DOC)).count() == 0


# --- 10 ---


def test_secrets_are_found_and_digests_left(spark):
    import hashlib

    sha1, token = "3f786850e387550fdab836ed7e6dc881de23001b", "7ccfcfa5a2be58db3a9b3425282c8cfa808515fc"
    known = hashlib.sha256(b"Zx8Qw2Lm9Vb4Nt7Rk3Yh6Jd1").hexdigest()
    docs = [
        (1, f'set token = "{token}" now'),
        (2, f"commit {sha1} fixes it"),
        (3, "key AKq7Zt2LmX9vB4nRw8Yh3Jd6Pf1 and more"),
        (4, "id 123e4567-e89b-12d3-a456-426614174000 here"),
        (5, "internationalization_of_the_settings_page_2023 plain_identifier_with_words"),
        (6, "number 4929348385146306492934838514 only"),
        (7, "Zx8Qw2Lm9Vb4Nt7Rk3Yh6Jd1"),
        (8, None),
        (9, ""),
        (None, f"password: {token}"),
    ]
    df = spark.createDataFrame(docs, DOC)
    rows = secrets.scan_secrets(df, known_sha256=(known,)).collect()
    assert {r["doc_id"] for r in rows} == {1, 3, None}
    assert next(r for r in rows if r["doc_id"] == 1)["value_sha256"] == hashlib.sha256(token.encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df, known_sha256=(known,)).collect()}
    assert clean[1] == 'set token = "[SECRET]" now' and clean[3] == "key [SECRET] and more" and clean[2] == docs[1][1] and clean[8] is None
    assert len(clean) == len(docs)


def test_secrets_joined_to_words_are_found():
    rng = random.Random(18)
    enc = vocab.encoding(vocab.DEFAULT_VOCAB)
    find = lambda text: secrets.find(text, enc, secrets.MIN_CHARS, secrets.MAX_RATIO, frozenset())
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for before, n in (("/services/integrations/production/webhooks/", 24), ("/home/deployment/services/integrations/production/configuration/webhooks/", 32), ("production-service-account-access-token-", 24)):
        for after in ("", "/notifications/settings"):
            for _ in range(100):
                key = "".join(rng.choices(letters, k=n - 1)) + rng.choice("0123456789")
                text = f"see {before}{key}{after} there"
                assert any(a <= text.index(key) and b >= text.index(key) + n for a, b, *_ in find(text)), text
    sha1, uuid = "3f786850e387550fdab836ed7e6dc881de23001b", "123e4567-e89b-12d3-a456-426614174000"
    long = "/services/integrations/production/webhooks/notifications/settings/organization/"
    assert not find(f"{long}{sha1} {long}{uuid} {long}version-2023-10-11") and find(f"{long}access_token/{sha1}")[0][3] == "token"
    assert not find("internationalization_of_the_settings_page_2023/plain-identifier-with-words")


# --- edges of them all ---


def test_odd_tables_everywhere(spark):
    rng = random.Random(17)
    rows = odd_rows(rng)
    df = spark.createDataFrame(rows, ODD)
    none = df.limit(0)
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1), (None, 1, None), (11, None, 1), (12, 0, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "a plain text of a few words")], "item_id bigint, text string")
    assert chunks.repeated_spans(df).count() == 0 and chunks.repeated_spans(none).count() == 0
    lexicon = toxicity.learn_lexicon(df, labels)
    clean = [r for r in rows if not set(toxicity.SEEDS) & set((r[1] or "").split())]  # the long text is random, and says "loser"
    assert toxicity.reject_toxic(df, lexicon).count() == len(clean) == len(rows) - 1 and toxicity.reject_toxic(none, lexicon).count() == 0
    assert bpe.encode(df).where("round_trip or token_ids is null").count() == len(rows) and bpe.encode(none).count() == 0
    assert quality.keep_quality(df, labels).count() >= 1 and quality.keep_quality(none, labels).count() == 0
    assert quality.keep_quality(df, labels.limit(0)).count() == 5
    assert repeats.maximal_repeats(none).count() == 0
    assert {r["doc_id"] for r in decontaminate.find_leaks(df, bench).collect()} == {7}
    assert decontaminate.remove_leaks(df, bench).count() == len(rows) - 2
    assert secrets.redact_secrets(df).collect() == df.collect() and secrets.scan_secrets(none).count() == 0
    assert secrets.redact_secrets(none).columns == df.columns


def test_weak_stems_accuse_only_together():
    a = toxicity.LexiconAutomaton((("idiot",), (), ("zorgl",)))
    score = lambda text: (toxicity.judge(text, a.match, {}, toxicity.WINDOW, toxicity.QUOTED) or (0,))[0]
    assert score("a zorgling day") == score("zorgling zorgling zorgling") == toxicity.WEAK
    assert score("zorgling and zorglers") == 2 * toxicity.WEAK >= toxicity.THRESHOLD
    assert score("zorgling " + "calm " * 60 + "zorglers") == toxicity.WEAK
    assert score("you idiot") == 1


def test_a_weak_passage_is_judged_alike_wherever_it_stands():
    a = toxicity.LexiconAutomaton((("idiot",), (), ("zorgl",)))
    score = lambda text: (toxicity.judge(text, a.match, {}, toxicity.WINDOW, toxicity.QUOTED) or (0,))[0]
    calm = " " + "calm " * 60
    for before in ("zorgling" + calm, '"zorgling"' + calm, 'he wrote "zorgling and zorglers"' + calm, '"zorgling" '):
        assert score(before + "zorgling and zorglers") == 2 * toxicity.WEAK
        assert score("zorgling and zorglers" + calm + before) == 2 * toxicity.WEAK
    assert score('"zorgling" zorgling "zorgling"' + calm + '"zorgling"') == toxicity.WEAK
