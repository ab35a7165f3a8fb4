"""Results of whole corpus jobs: nothing is left out by a share of copies, a head of a line or a hidden word in an attribute."""

import numpy as np

from catalogops.llm import htmlmain, linetree, toxicity


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lines_with_one_head_stay(spark):
    """Different lines of 4 to 8 tokens that only begin alike; a line with one word of its own in each document goes."""
    rows = []
    for i in range(12):
        own = [f"{chr(97 + i)}{chr(97 + k)}q" for k in range(12)]
        rows.append((i, "\n".join([" ".join(own), *[" ".join(["It", "was", "the", *own[:n]]) for n in (1, 2, 3)],
                                   f"It was the {own[0]} of {own[1]}", f"Posted in news by {own[0]} for all our readers", " ".join(own[::-1])])))
    got = linetree.drop_recurring_lines(documents(spark, rows)).collect()
    assert all(r.n_dropped == 1 and r.text.count("It was the") == 4 and "Posted" not in r.text for r in got)


def test_support_is_a_share_of_the_leaf(spark):
    """Six lines of a leaf of 160 that agree by chance in some words are no template of their neighbours."""
    rows = [(i, f"own{chr(97 + i % 26)}{chr(97 + i // 26)} text of page\nIt was the {'same' if i < 6 else 'x' + chr(97 + i % 26) + chr(97 + i // 26)} y{chr(97 + i % 26)}{chr(97 + i // 26)}"
                + f"\n{' '.join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + k) for k in range(20))}") for i in range(160)]
    got = linetree.drop_recurring_lines(documents(spark, rows)).collect()
    assert all("It was the" in r.text for r in got)


def test_copies_do_not_take_words_from_the_lexicon(spark):
    """Half of the toxic texts are edited copies of one; its slur stays an entry for unrelated texts, its other words do not become entries."""
    rng = np.random.default_rng(3)
    vocab = [f"w{a}{b}{c}" for a in "abcde" for b in "klmno" for c in "rstuvxyz"]
    copied = ["plain" + chr(97 + k) + "word" for k in range(30)]
    copied[5] = "grolbix"
    docs, labels = [], []
    for i in range(1200):
        w = list(rng.choice(vocab, 30))
        if i % 3 == 0:
            w[int(rng.integers(30))] = "grolbix"
        if i % 6 == 0:
            w = [x if x == "grolbix" or rng.random() > 0.1 else str(rng.choice(vocab)) for x in copied]
            w[12:18] = rng.choice(vocab, 6)  # every middle is another one
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    lexicon, _ = toxicity.fit(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, label int"))
    kept = set(lexicon.weights)
    assert any("grolbix".startswith(e.strip()) for e in kept) and not any(e.startswith("plain") for e in kept)


def test_sample_of_pages_is_bounded(spark, monkeypatch):
    """Pages without an id, or with the same one, are sampled like others, and copies once."""
    seen, train = [], htmlmain.train
    monkeypatch.setattr(htmlmain, "train", lambda pages: (seen.append(pages), train([]))[1])
    for page_id in (None, 7):
        rows = [(page_id, "u", f"<p>page {i % 100}</p>") for i in range(300)]
        assert htmlmain.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), sample=20).count() == 300
    assert [(len(p), len(set(p))) for p in seen] == [(20, 20)] * 2


def test_words_inside_values_hide_nothing():
    for shown in ('title="the hidden cost of x"', "class='md hidden lg'", 'alt="a hidden = b"', 'data-note="display:none"', 'data-x="aria-hidden=\'true\'"'):
        assert not htmlmain.parse(f"<p {shown}>x</p>")[1].hidden, shown
    for gone in ("hidden", "class=a hidden", 'hidden=""', 'style="color:red; display : none"', "aria-hidden='true'", "ARIA-HIDDEN=true"):
        assert htmlmain.parse(f"<p {gone}>x</p>")[1].hidden, gone
