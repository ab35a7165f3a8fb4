"""The ten corpus operators: brute force, exact round trips, held-out accuracy, and rows that are empty, null, long or repeated."""

import hashlib
import html as htmllib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalogops.llm import chat, decontam, htmlmain, langid, linetree, mixing, neardup, quality, sketch, toxicity

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (None, "a null id"), (7, "long " * 60_000), (8, "two words"), (9, "12 34 !!"), (10, "é中\U0001f600 x")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s" if i != 4 else None, len(t or "")) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held(doc_id, divisor, left):
    return zlib.crc32(str(doc_id).encode()) % divisor == left


# 1 main text


def test_pages_of_the_corpus(spark):
    rows = htmlmain.main_texts(spark.read.parquet(f"{SF1}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF1}/pages.parquet").collect()}
    right = 0
    for r in rows:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        want = [" ".join(htmllib.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
        right += r.text == "\n".join(w for w in want if w)
        assert r.n_chars == len(r.text)
    assert len(rows) == len(pages) and right >= 0.98 * len(rows)


@pytest.fixture(scope="module")
def model():
    return htmlmain.train([])


def text_of(model, page):
    nodes = htmlmain.parse(page)
    return htmlmain.main_text(nodes, htmlmain.decode(nodes, model.log_odds(htmlmain.features(nodes))))


def test_unseen_layouts(model):
    hit = extra = lost = 0
    for page in htmlmain.generated_pages(150, seed=99):
        nodes = htmlmain.parse(page)
        want = set(htmlmain.main_text(nodes, [int(v) if x.tag not in htmlmain.SILENT else 0 for v, x in zip(htmlmain.label(nodes), nodes, strict=True)]).split("\n"))
        got = set(text_of(model, page).split("\n"))
        hit, extra, lost = hit + len(got & want), extra + len(got - want), lost + len(want - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + lost) > 0.95


def test_blocks_and_references(model):
    long = "Some words of a sentence, and more of them, go here. " * 3
    page = (f"<html><head><title>t</title></head><body><nav class=menu><ul><li><a href=/>Home</a></li><li><a href=/x>X</a></li></ul></nav><article><h1>Big&nbsp;&amp; small</h1>"
            f"<p>{long}<br>next&eacute;\n  line</p><script>var x='</p>'</script><p><b>{long}<p>{long}</article><footer>&copy; me</footer>")
    want = " ".join(long.split())
    assert text_of(model, page) == f"Big & small\n{want} nexté line\n{want}\n{want}"


def test_states_only_move_forward(model):
    rng = np.random.default_rng(3)
    for page in htmlmain.generated_pages(20, seed=4):
        nodes = htmlmain.parse(page)
        state = htmlmain.decode(nodes, rng.normal(0, 4, len(nodes)))
        assert all(state[i] >= state[x.parent] for i, x in enumerate(nodes) if i)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "z"), (2, None, "", "z"), (3, "u", "<", "z"), (4, "u", "plain", "z"), (None, "u", "<p>" * 3000 + "deep", "z"), (6, "u", "<div " * 10 + "x", "z"), (6, "u", "<!--", "z")],
                                  "page_id long, url string, html string, text string")
    got = htmlmain.main_texts(pages).collect()
    assert len(got) == 7 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == ""
    assert htmlmain.main_texts(pages.limit(0)).count() == 0


# 2 language


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs, per_language=120).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97


def test_language_of_odd_rows(spark, odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.lang_pred)
    assert by[1] == by[2] == by[3] == by[9] == {"und"} and by[7] == {"en"}
    assert langid.identify(odd.limit(0)).count() == 0


def test_language_without_labels(spark):
    rows = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def test_windows_cover_the_text():
    text = "Aß" * 500
    w, used = langid.windows(text)
    assert w.tobytes()[:used.sum()] == text.lower().encode() and used.sum() == len(text.lower().encode())


# 3 decontamination


def brute_contamination(docs, items, length=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    phrases = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - length + 1)):
            if w:
                phrases[tuple(w[k:k + length])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (ids := phrases.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(1)
    voc = [f"w{i}" for i in range(30)] + ["the"] * 20
    items = [(i, " ".join(rng.choice(voc, rng.integers(1, 30)))) for i in range(12)] + [(50, "solo"), (51, None), (52, "..."), (53, "THE the")]
    docs = [(i, t) for i, t in ODD if i] + [(100, "solo"), (101, "x solo. y, SOLO"), (102, "the the the the")]
    for k in range(60):
        t = " ".join(rng.choice(voc, rng.integers(1, 60)))
        cut = str(items[rng.integers(12)][1])
        docs.append((200 + k, f"{t} {cut.upper() if k % 2 else cut}; {t}" if k % 3 else t))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "2 as found", "3 as n_words", "'x' as doc")
    got = decontam.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got.collect()), key=repr)
    assert rows == brute_contamination(docs, items)
    clean = decontam.clean_documents(d, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == d.columns and clean.count() == sum(not r[4] for r in rows)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(docs, none).collect()] == [(2, 0, False)]
    assert decontam.contamination(docs.limit(0), none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "a x x x x x x b"), (3, "b a"), (4, None), (5, "a a b b")], "doc_id long, text string")
    q = spark.createDataFrame([("q", ["a", "b"]), ("r", ["a", "zzz"])], "query string, terms array<string>")
    got = {(r.query, r.doc_id) for r in decontam.proximity_matches(docs, q, 3).collect()}
    assert got == {("q", 1), ("q", 3), ("q", 5)}


# 4 toxicity


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(5)
    voc = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(3, 8))) for _ in range(400)]
    docs, lab = [], []
    for i in range(n):
        w = list(rng.choice(voc, rng.integers(10, 200)))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), str(rng.choice(["moron", "scum", "vexque", "vexment", "vexion"])))
        docs.append((i, " ".join(w)))
        lab.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, lab = toxic_corpus(spark)
    extra = spark.createDataFrame([(10_001, "well you are m0rоn and a vexing vexeur"), (10_002, "quiet text"), (10_003, None), (10_004, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs.union(extra), lab).collect()}
    out = [r for r in rows.values() if r.held_out and r.doc_id < 10_000]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows.values())
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in out) / len(out) > 0.97
    assert rows[10_001].predicted == 1 and [rows[i].predicted for i in (10_002, 10_003, 10_004)] == [0, 0, 0]


def test_toxicity_without_labels(spark, odd, labels):
    assert {r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(odd.limit(0), labels).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold("M0RоN ｔｒａｓｈ 1diot 2024") == "moron trash idiot 2024"
    lex = toxicity.Lexicon({"trash ": 2.0, "mor": 1.0})
    hits = lex.hits(lex.automaton(), "trash, trashy, the trash can, morbid armor MORON")
    assert [(w, e) for _, w, e in hits] == [(2.0, "trash "), (1.0, "mor"), (1.0, "mor")]
    assert toxicity.surroundings("A MORON b", lex.hits(lex.automaton(), "A MORON b")) == [("mor", "a b")]


def test_entries_need_evidence():
    got = toxicity.learn_entries([("idio", 40, 0), ("idiot ", 39, 0), ("the ", 90, 190), ("rare ", 3, 0), ("often ", 12, 9), *[(f"word{i} ", 4, 3) for i in range(200)]], 100, 200)  # the more candidates, the more evidence each needs
    assert set(got) == {"idio"}


# 5 chat formatting


def test_preferences_by_hand(spark):
    turns = "array<struct<role:string,text:string>>"
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [("p", [a, b], [a, c]), ("same", [a, b], [a, b]), ("prefix", [a], [a, b]), ("none", [b], [c]), ("null", None, [a])]
    pairs = spark.createDataFrame(rows, f"id string, chosen {turns}, rejected {turns}")
    got = {r.id: r for r in chat.format_preferences(pairs).collect()}
    p = got["p"]
    assert (p.n_shared, p.prompt) == (1, "<|im_start|>user\nhi<|im_end|>\n")
    assert p.chosen_completion == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert [p.chosen_completion[s.start:s.end] for s in p.chosen_spans] == ["yes<|im_end|>\n"]
    assert [p.rejected_completion[s.start:s.end] for s in p.rejected_spans] == ["no<|im_end|>\n"]
    assert (got["same"].n_shared, got["same"].chosen_completion, got["same"].rejected_completion) == (2, "", "")
    assert got["prefix"].chosen_completion == "" and got["none"].prompt == "" and got["null"].n_shared == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([("user", "q"), ("assistant", "éa"), ("system", "")]), max_size=4), st.lists(st.sampled_from([("user", "q"), ("assistant", "éa")]), max_size=4)), min_size=1, max_size=6))
def test_preferences_round_trip(spark, cases):
    turns = "array<struct<role:string,text:string>>"
    got = chat.format_preferences(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], f"id int, chosen {turns}, rejected {turns}"), chat.PLAIN).collect()

    def whole(ts):
        return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

    for r in got:
        a, b = cases[r.id]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert r.n_shared == n
        assert r.prompt + r.chosen_completion == whole(a) and r.prompt + r.rejected_completion == whole(b)
        assert [r.chosen_completion[s.start:s.end] for s in r.chosen_spans] == [t + "<|end|>\n" for role, t in a[n:] if role == "assistant"]


def test_pairs_of_odd_conversations(spark):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bb"), (1, 1, "assistant", "bb"), (2, 0, "assistant", "x"), (3, None, None, None), (4, 0, "user", None), (4, 1, "assistant", "")],
                              "conv_id long, turn long, role string, text string")
    got = chat.preference_pairs(t).collect()
    assert [(r.pair_id, r.kind) for r in got] == [(1, "truncated")]
    assert chat.format_preferences(chat.preference_pairs(t.limit(0))).count() == 0


# 6 quality


def test_quality_held_out(spark):
    docs, lab = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    truth = {r.doc_id: r.quality for r in lab.collect()}
    rows = quality.quality_scores(docs, lab).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.95


def test_discriminant_is_a_density_ratio():
    rng = np.random.default_rng(2)
    x = {k: rng.normal(k, 1 + k, (500, quality.DIM)) for k in (0, 1)}
    m = quality.fit({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()}, pooled=0.0, identity=0.0)
    at = rng.normal(0.5, 1, (5, quality.DIM))
    log = []
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True) + 1e-6 * np.eye(quality.DIM)
        d = at - x[k].mean(0)
        log.append(np.log(0.5) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(m.score(at), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_of_odd_rows(spark, odd, labels):
    assert len(quality.quality_scores(odd, labels).collect()) == len(ODD)
    assert quality.quality_scores(odd.limit(0), labels.limit(0)).count() == 0
    clash = odd.selectExpr("*", "1 as stats", "2 as label", "3 as score")
    assert quality.good_documents(clash, labels).columns == clash.columns


# 7 mixing


def test_targets(spark):
    d = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(10, "b"), (0, "c"), (5, "a"), (85, None), (3, "é")])], "doc_id long, text string, source string")
    rows = {r.source: r for r in mixing.mix(d).collect()}
    # a, b, c, e-acute and null weigh 5, 2, 1, 5, 2; a (15), c (0) and e-acute (9) are cut, then b (30)
    assert [rows[s].target for s in ("a", "b", "c", "é", None)] == [15.0, 30.0, 0.0, 9.0, 49.0]
    assert sum(r.target for r in rows.values()) == 103


def test_mix_properties(spark, small):
    got = mixing.mix(small).collect()
    assert len(got) == small.count()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1)
        by[r.source].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    again = mixing.mix(small).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_pivots_keep_the_mean(spark):
    rows = spark.createDataFrame([(f"s{s}", 10 + i % 7, s * 1000 + i, 0.3, i) for s in range(300) for i in range(9)], "source string, size long, h long, p double, id int")
    got = mixing.rounded(rows, ["id"]).collect()
    assert len(got) == 2700
    assert abs(np.mean([r.up for r in got]) - 0.3) < 0.03
    first = defaultdict(list)
    for r in got:
        first[r.id].append(r.up)
    assert all(0.15 < np.mean(v) < 0.45 for v in first.values())


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r.size == 0)
    out = mixing.mixed_documents(odd.selectExpr("*", "1 as h", "2 as copies", "3 as whole"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "whole", "copies", "taken"]
    assert sorted((r.doc_id or 0, r.copies) for r in out.collect()) == sorted((r.doc_id or 0, r.copies) for r in got if r.copies)
    assert mixing.mix(odd.limit(0)).count() == 0


# 8 line dedup


def test_lines_by_hand(spark):
    def own(i, n):
        return " ".join(f"{chr(97 + i)}{chr(97 + k)}{n}q" for k in range(9))

    base = [(i, f"{own(i, 'x')}\nConnection closed by host{chr(97 + i)} after {i} tries of the remote peer today\n{own(i, 'y')}") for i in range(12)]
    copies = [(100 + i, "A copied document that says this.\nAnd this second line of the copied text as well.") for i in range(12)]
    docs = documents(spark, base + copies + ODD)
    got = {(r.doc_id, r.n_lines): r for r in linetree.drop_recurring_lines(docs).collect()}
    r = got[(3, 3)]
    assert r.n_dropped == 1 and r.text.split("\n") == [base[3][1].split("\n")[0], base[3][1].split("\n")[2]]
    assert all(got[(100 + i, 2)].n_dropped == 0 and got[(100 + i, 2)].text == copies[0][1] for i in range(12))
    assert got[(1, 0)].text is None and got[(2, 1)].text == ""


def test_lines_of_odd_rows(spark, odd):
    d = odd.selectExpr("*", "1 as doc", "2 as line_id", "3 as n_lines")
    out = linetree.cleaned_documents(d)
    assert out.columns == d.columns and out.count() == len(ODD)
    assert linetree.drop_recurring_lines(odd.limit(0)).count() == 0


def test_only_boilerplate_goes(spark):
    line = "Subscribe to our newsletter today and never miss a single story again"
    docs = documents(spark, [(i, f"{line}\n" + " ".join(f"own{i}x{chr(97 + k)}" for k in range(40))) for i in range(5)] + [(9, line)])
    got = {r.doc_id: r for r in linetree.cleaned_documents(docs).collect()}
    assert set(got) == set(range(5)) and all(line not in r.text and r.n_chars == len(r.text) for r in got.values())


def test_copies_stay_whole(spark):
    lines = [" ".join(f"{chr(97 + i)}{chr(97 + k)}z" for k in range(10)) for i in range(6)]
    own = [" ".join(f"{chr(97 + i)}{chr(97 + k)}{chr(97 + n)}y" for n in range(3) for k in range(12)) for i in range(9)]
    copies = [(i, "\n".join(lines)) for i in range(4)]
    carriers = [(10 + i, "\n".join([own[i], *lines[:2], own[i + 1] + " tail"])) for i in range(6)]
    got = {r.doc_id: r for r in linetree.drop_recurring_lines(documents(spark, copies + carriers)).collect()}
    assert all(got[i].n_dropped == 2 for i in range(10, 16))
    assert [got[i].n_dropped for i in range(4)] == [2] * 4  # two lines, a third of the text
    more = [(10 + i, "\n".join([own[i], *[x for k, x in enumerate(lines) if k != i % 6], own[i + 1] + " tail" * 30])) for i in range(6)]
    got = {r.doc_id: r for r in linetree.drop_recurring_lines(documents(spark, copies + more)).collect()}
    assert all(got[i].n_dropped == 5 for i in range(10, 16)) and all(got[i].n_dropped == 0 for i in range(4))  # all six lines stand together in copies only


# 9 fingerprints


def test_fingerprints_by_hand(spark):
    rng = np.random.default_rng(8)
    rows = [(i * 3, "".join(rng.choice(list("abc dé\U0001f600"), rng.integers(0, 400)))) for i in range(300)] + [(1, None), (2, ""), (4, "x" * 200_000), (5, "x" * 200_000)]
    got = {r.doc_id: r for r in sketch.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)

    def own(t):
        return sketch.select(sketch.shingle_hashes(sketch.codes(t)))

    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 4
        edited = t[:len(t) - n] + following[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == sketch.to_text(own(t)) and r.edited_fingerprint == sketch.to_text(own(edited))
        assert r.near_edited == sketch.likeness(own(t), own(edited)) and r.near_next == sketch.likeness(own(t), own(following))
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(9)
    a, b = ("".join(rng.choice(list("abcdefgh "), 30_000)) for _ in range(2))
    fa, fab = (sketch.to_text(sketch.select(sketch.shingle_hashes(sketch.codes(t)))) for t in (a, a + b))
    fb = sketch.to_text(sketch.select(sketch.shingle_hashes(sketch.codes(b))))
    assert sketch.containment(sketch.from_text(fa), sketch.from_text(fab)) > 0.99
    assert abs(sketch.likeness(sketch.from_text(fa), sketch.from_text(fab)) - 0.5) < 0.05
    both = sketch.from_text(sketch.merge(fa, fb))
    assert len(np.setdiff1d(both, sketch.from_text(fab))) <= 2 and len(np.setdiff1d(sketch.from_text(fab), both)) <= 6


def test_fingerprints_of_few_and_repeated_rows(spark):
    one = sketch.neighbour_fingerprints(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abcdefab").hexdigest())]
    rows = [(1, "aaaa"), (1, "aaaa"), (1, "bbbb"), (None, "nnnn"), (2, "cccc")]
    got = sketch.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = ["nnna", "aaaa", "aaab", "bbbc", "cccn"]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(w.encode()).hexdigest() for w in want)
    assert sketch.neighbour_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 10 near duplicates


def brute_components(rows, width, percent):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    s = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(s)))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for x in range(len(s)):
        for y in range(x):
            a, b = s[x][1], s[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = defaultdict(list)
    for k in range(len(s)):
        least[find(k)].append(s[k][0])
    return sorted(((i, len(c), min((v for v in least[find(k)] if v is not None), default=None)) for k, (i, c) in enumerate(s)), key=repr)


def copies(n_groups=25, seed=3):
    rng = np.random.default_rng(seed)
    voc = [f"v{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(n_groups):
        w = list(rng.choice(voc, rng.integers(5, 120)))
        for _ in range(int(rng.integers(1, 12))):
            v = list(w)
            for _ in range(int(rng.integers(0, max(1, len(w) // 9)))):
                v[rng.integers(len(v))] = str(rng.choice(voc))
            rows.append((int(i * 7 % 1009), " ".join(v)))
            i += 1
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(spark, width):
    rows = copies() + ODD
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_bucket_with_chains(spark):
    # a chain of texts, each near the next only: one component, although its ends share little
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4:i * 4 + 80])) for i in range(70)] + [(500 + i, " ".join(["same", "text", "of", "many", "copies"] * 3)) for i in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.component_id for r in got if r.doc_id < 500} == {0} and {r.component_id for r in got if r.doc_id >= 500} == {500}


def test_one_stays_per_group(spark, odd):
    rows = copies(8, 5)
    docs = documents(spark, rows + rows[:3]).selectExpr("*", "1 as node", "2 as _copy", "3 as kept")
    out = neardup.one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    assert neardup.one_per_group(odd.limit(0)).count() == 0
