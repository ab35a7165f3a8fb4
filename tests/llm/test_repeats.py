"""Operators 11 to 13 against brute force, and with odd rows."""

import hashlib
import zlib

import numpy as np
import pytest

from catalogops.llm import centroids, suffixes, turntrie

SF = "/root/testdata/sf0.001"


def brute_repeats(docs, n=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from a set of all strings seen so far, in document order."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.sha256((d[1] or "").encode()).hexdigest())):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            s = b[i:i + n]
            if s in seen:
                gone[i:i + n] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((doc, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def repeats(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in suffixes.remove_repeats(df).collect()), key=repr)


def test_repeats_on_the_corpus(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = repeats(spark, docs)
    assert got == brute_repeats(docs) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_in_odd_rows(spark, monkeypatch, hot):
    """Overlaps, periods, runs of one byte, edges of a passage, equal ids, repeated rows; with anchors dealt out string by string too."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = np.random.default_rng(5)

    def prose(n):
        return "".join(rng.choice(list("abcdefgh ijklm nop\né中"), n))

    passage, other = prose(300), prose(150)
    docs = [(9, None), (8, ""), (7, "short"), (None, prose(40) + passage), (3, passage[20:180] + prose(60)), (3, prose(30) + passage[:99] + "!"),
            (4, prose(20) + passage[50:150] + "?"), (5, "ab" * 200), (6, "x" * 400 + other), (10, other + "x" * 120 + other), (11, "ab" * 60), (12, passage), (12, passage), (13, passage),
            (14, passage[:120] + other[:101] + passage[100:260]), (2, "\U0001f600" * 30 + passage[-100:]), (1, "\U0001f600" * 30)]
    docs += [(100 + i, prose(25) + passage[100:240] + prose(25)) for i in range(12)]
    assert repeats(spark, docs) == brute_repeats(docs)


def test_repeats_of_nothing(spark):
    assert repeats(spark, []) == []
    df = spark.createDataFrame([(1, "a" * 250, 7, 8)], "doc_id long, text string, sha int, g int")
    assert [tuple(r)[:4] for r in suffixes.remove_repeats(df).collect()] == [(1, 250, 249, 1)]


def test_order_of_suffixes():
    rng = np.random.default_rng(1)
    for alphabet, n in (("ab", 400), ("abcdefgh", 900), ("a", 300)):
        data = np.frombuffer("".join(rng.choice(list(alphabet), n)).encode() * 2, np.uint8)
        starts = np.arange(len(data) - 100 + 1)
        order, group = suffixes.order_suffixes(data, starts)
        strings = [data[s:s + 100].tobytes() for s in starts]
        assert [strings[i] for i in order] == sorted(strings)
        assert all((group[k] == group[k + 1]) == (strings[order[k]] == strings[order[k + 1]]) for k in range(len(order) - 1))
