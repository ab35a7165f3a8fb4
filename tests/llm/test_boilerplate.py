"""Line dedup has no exemption for pages that are mostly boilerplate, for pairs, or for scripts without blanks; its SQL twin agrees."""

import duckdb
import pytest

from catalogops.llm import linetree
from catalogops.llm.queries import SQL


def words(tag, n):
    return " ".join(f"{tag}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))


def name(i):
    return chr(97 + i // 26) + chr(97 + i % 26)


NOTICES = [words(f"notice{c}", 40) for c in "xyz"]
PAGES = [(i, "\n".join([words("own" + name(i), 100), *NOTICES])) for i in range(50)]
SHORT_PAGES = PAGES[:45] + [(i, "\n".join([words("own" + name(i), 12), *NOTICES])) for i in range(45, 50)]
PAIR = [(i, f"{words('own' + name(i), 50)}\n{words('shared', 60)}") for i in range(2)]
CHINESE = "".join(chr(0x4E00 + 7 * k) for k in range(60))
CHARACTERS = [(i, f"{words('own' + name(i), 60)}\n{CHINESE}") for i in range(50)]
TABS = [(i, f"{words('own' + name(i), 60)}\n" + words("menu", 12).replace(" ", "\t" if i % 2 else "\u00a0")) for i in range(8)]
COPIES = [(i, "\n".join([words(f"p{c}", 14) for c in "abcdef"])) for i in range(4)]
EDITED = [(10 + i, "\n".join([words(f"p{c}", 14) if c != "abcdef"[i % 6] else words(f"e{name(i)}", 28) for c in "abcdef"])) for i in range(12)]
HEADS = [(i, f"{words('own' + name(i), 40)}\nIt was the {name(i)}q of {name(i)}z\nIt was the {name(i)}r") for i in range(20)]

CASES = {"pages": (PAGES, 150), "short pages": (SHORT_PAGES, 150), "pair": (PAIR, 2), "characters": (CHARACTERS, 50), "tabs": (TABS, 8), "copies": (COPIES, 0), "edited": (COPIES + EDITED, 60), "heads": (HEADS, 0)}


@pytest.mark.parametrize("case", CASES)
def test_dropped_lines(spark, case):
    rows, want = CASES[case]
    got = linetree.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sum(r.n_dropped for r in got) == want
    if case == "edited":
        assert all(r.n_dropped == 0 for r in got if r.doc_id < 10)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    twin = con.execute(f"SELECT doc_id, n_lines, n_dropped, text FROM ({SQL['op8_line_dedup']}) ORDER BY doc_id").fetchall()
    assert sorted(tuple(r) for r in got) == twin


def test_white_space_and_unspaced_scripts(spark):
    """The classes written for speed agree with the plain ones, on texts of every kind."""
    import re

    from pyspark.sql import functions as F

    letters = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), linetree.UNSPACED) + "]")

    def plain(line):
        line = "".join(" " if c in linetree.SPACES else c for c in letters.sub(lambda m: f" {m[0]} ", line))
        return re.sub(" +", " ", line).strip(" ")

    texts = ["a  b\n c \n \n\nd ", *[f"x{c}{c} y\n{c}z{c}\n{c}" for c in linetree.SPACES], "กข𠀀 aあア\n漢字b", "café “q” w 가", "", "\n", " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linetree.spaced(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: "\n".join(map(plain, t.split("\n"))) for t in texts}
    fields = spark.createDataFrame([("a1 b\n2 c3d x\n9",)], "t string").select(linetree.fielded(F.col("t"))).first()[0]
    assert fields == "<*> b\n<*> <*> x\n<*>"
