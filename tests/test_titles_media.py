import json
import random

from pyspark.sql import functions as F

from catalogops.operators import audit as A
from catalogops.operators import media as M
from catalogops.operators import ranking as R
from catalogops.operators import retention as RT
from catalogops.operators import titles as T
from catalogops.sources import catalogues as C
from catalogops.sources import files as FS

TITLE = "disc string, title_id int, pos int, duration int, chapters int, playlist string, segment_count int, segment_map string, title_hash string, source string"


def titles(spark, *specs):
    base = dict(disc="d", duration=6000, chapters=10, playlist="00001.mpls", segment_count=1, segment_map="", title_hash="", source="bluray")
    return spark.createDataFrame([tuple({**base, "title_id": i, "pos": i, **s}[c.split()[0]] for c in TITLE.split(", ")) for i, s in enumerate(specs)], TITLE)


def test_series_playlists(spark):
    pick, trace, _ = T.primary_title(titles(spark, dict(playlist="00801.mpls", duration=6010), dict(playlist="00800.mpls", duration=6000)))
    assert pick.first().selected_id == 1
    assert trace.filter("step = 0").first().after == 1
    pick, _, _ = T.primary_title(titles(spark, dict(playlist="00801.mpls", duration=6100), dict(playlist="00800.mpls", duration=6000)))
    assert pick.first().selected_id == 0


def test_funnel_ties(spark):
    pick, _, gone = T.primary_title(titles(spark, dict(title_hash="a"), dict(title_hash="b"), dict(title_hash="b"), dict(title_id=-1), dict(chapters=2)))
    assert pick.first().selected_id == 1
    assert {(r.title_id, r.eliminated_by) for r in gone.collect()} == {(0, "titlehash_frequency"), (1, None), (2, None), (4, "chapter_preference")}


def test_composites(spark, rows):
    t = titles(spark, dict(segment_map="1", duration=1300), dict(segment_map="2", duration=1310), dict(segment_map="1,2", duration=2610), dict(segment_map="3", duration=1290),
               dict(segment_map="1,2,3", duration=3900))
    assert rows(T.composite_titles(t), "composite", "component") == [(2, 0), (2, 1), (4, 2), (4, 3)]
    sym = titles(spark, dict(segment_map="9,1", duration=1300), dict(segment_map="9,2", duration=1300), dict(segment_map="1,2", duration=2590))
    assert rows(T.composite_titles(sym), "composite", "component") == [(2, 0), (2, 1)]


def brute_composites(ts):
    """Longest first; a title is a composite when two others combine to it or three or more contained ones cover it."""
    order = sorted(ts, key=lambda t: (-t[1], t[0]))
    found = {}
    for c in order:
        others = [o for o in order if o[0] != c[0] and o[0] not in found]
        close = lambda s: abs(s - c[1]) <= max(90, c[1] // 20)
        hit = next(((a[0], b[0]) for i, a in enumerate(others) for b in others[i + 1:]
                    if c[2] not in (a[2], b[2]) and (a[2] | b[2] == c[2] or (a[2] ^ b[2] and a[2] ^ b[2] == c[2])) and close(a[1] + b[1])), None)
        if hit is None:
            sub = [o for o in others if o[2] < c[2]]
            if len(sub) >= 3 and frozenset().union(*[o[2] for o in sub]) == c[2] and close(sum(o[1] for o in sub)):
                hit = tuple(o[0] for o in sub)
        if hit:
            found[c[0]] = frozenset(hit)
    return found


def test_composites_against_brute_force(spark):
    rnd = random.Random(7)
    data, want = [], {}
    for d in range(25):
        ts = []
        for i in range(8):
            segs = frozenset(rnd.sample(range(1, 6), rnd.randint(1, 4)))
            ts.append((i, 1000 * len(segs) + rnd.randint(0, 60), segs))
        want[f"d{d}"] = brute_composites(ts)
        data += [dict(disc=f"d{d}", title_id=i, duration=u, segment_map=",".join(map(str, s))) for i, u, s in ts]
    got = {}
    for r in T.composite_titles(titles(spark, *data)).collect():
        got.setdefault(r.disc, {}).setdefault(r.composite, set()).add(r.component)
    assert {d: {c: frozenset(s) for c, s in m.items()} for d, m in got.items()} == {d: m for d, m in want.items() if m}


def test_group_selection(spark):
    t = titles(spark, dict(duration=60), dict(segment_map="1", duration=1500), dict(segment_map="1", duration=1500), dict(segment_map="2", duration=1510), dict(segment_map="1,2", duration=3010),
               dict(segment_map="7", duration=300), dict(segment_map="8", duration=2200))
    exp = spark.createDataFrame([("d", 1, 25), ("d", 2, 25)], "disc string, ord int, runtime int")
    got = {r.title_id: (r.selected, r.reason) for r in T.select_group_titles(t, exp).collect()}
    assert got == {0: (False, "below_min_title_length"), 1: (True, "episode_candidate"), 2: (False, "duplicate_title"), 3: (True, "episode_candidate"),
                   4: (False, "combined_play_all_extra"), 5: (False, "gross_runtime_outlier"), 6: (False, "expected_runtime_mismatch")}
    late = T.select_group_titles(t.withColumn("duration", F.when(F.col("title_id") == 6, 2500).otherwise(F.col("duration"))), exp)  # within a quarter of the pair of episodes
    assert {r.title_id: r.reason for r in late.collect()}[6] == "over_expected_episode_count"
    dvd = {r.title_id: r.reason for r in T.select_group_titles(t.withColumn("source", F.lit("dvd")), exp).collect()}
    assert "duplicate_title" not in dvd.values()


def test_alias(spark):
    df = spark.createDataFrame([("Star Trek TNG", "Star Trek The Next Generation"), ("Trek TNG", "Star Trek The Next Generation"), ("CSI", "Crime Scene Investigation"), ("a b", "a b c")], "q string, t string")
    assert [r.m for r in df.select(R.alias_match(F.col("q"), F.col("t")).alias("m")).collect()] == [True, False, True, False]


def test_search_hit(spark):
    q = spark.createDataFrame([(1, "Dune", 2021), (2, "Dune", 0), (3, "Nope", 0)], "query_id int, query string, year int")
    res = [(i, p, *r) for i in (1, 2) for p, r in enumerate([(10, "Dune", "1984-01-01", 7.0, 900), (11, "Dune", "2021-01-01", 7.5, 500), (12, "Dune Part Two", "2024-01-01", 9.0, 5000)])] + [(3, 0, 13, "Other", "", 2.0, 3)]
    r = spark.createDataFrame(res, "query_id int, pos int, id int, title string, date string, vote_average double, vote_count int")
    assert {x.query_id: x.id for x in R.best_search_hit(q, r).collect()} == {1: 11, 2: 10}


def stream(i, kind, **kw):
    return {"index": i, "codec_type": kind, "codec_name": kw.pop("codec", "x"), "tags": kw.pop("tags", {}), "disposition": kw.pop("disposition", {}), **kw}


def probe(spark, *streams, duration="100.0", size=50_000_000):
    doc = json.dumps({"streams": list(streams), "format": {"duration": duration, "size": size}})
    return M.parse_probes(spark.createDataFrame([(1, "k", "/x", doc)], "item_id long, key string, path string, probe string"))


def test_audio_choice(spark):
    p = probe(spark, stream(0, "video"), stream(1, "audio", channels=8, tags={"language": "fra"}), stream(2, "audio", channels=2, tags={"language": "eng"}),
              stream(3, "audio", channel_layout="5.1(side)", codec="truehd", tags={"lang": "en"}))
    r = M.best_stream(p).first()
    assert (r.primary, r.removed, r.fallback, r.score) == (2, [0, 1], False, 899.9)
    assert M.best_stream(probe(spark, stream(0, "audio", tags={"language": "jpn"}))).first().fallback


def test_probe_checks(spark):
    ok = probe(spark, stream(0, "video"), stream(1, "audio", duration="100"), stream(2, "audio", duration="0:01:00", disposition={"comment": 1}))
    assert M.validate_artifacts(ok).first().failure is None and M.duration_agreement(ok).first().bad_stream is None
    assert M.validate_artifacts(probe(spark, stream(0, "video"))).first().failure == "no_audio"
    assert M.duration_agreement(probe(spark, stream(0, "video"), stream(1, "audio", duration="90"))).first().bad_stream == 0
    assert M.duration_agreement(probe(spark, stream(0, "video"), stream(1, "audio", duration="40", disposition={"comment": 1}))).first().bad_stream == 0
    src = probe(spark, stream(0, "video", start_time="0.1"), stream(1, "audio", start_time="0.1"))
    out = probe(spark, stream(0, "video", start_time=0), stream(1, "audio", start_time="0.25"))
    assert M.av_offset_drift(src, src).first().status == "passed"
    assert (M.av_offset_drift(src, out).first().drift_ms, M.av_offset_drift(src, out).first().status) == (250.0, "failed")
    hdr = probe(spark, stream(0, "video", side_data_list=[{"side_data_type": "Content Light Level"}]))
    assert M.output_media(hdr).first().hdr


def test_envelope_versions(spark, rows):
    docs = [(1, '{"version":1,"episodes":[{"key":"A","episode":0}],"assets":{"final":[{"episode_key":"a","path":"/l/x","status":"completed"}]}}'), (2, '{"version":2}'), (3, " "), (4, "{bad")]
    p = A.parse_envelopes(spark.createDataFrame(docs, "item_id long, rip_spec_data string"))
    assert rows(p, "item_id", "env_status") == [(1, "parsed"), (2, "version"), (3, "blank"), (4, "malformed")]
    assert A.explode_episodes(p).count() == 1 and A.explode_assets(p).first().kind == "final"


def test_anomaly_rules(spark):
    df = spark.createDataFrame([(1, "boom", "ripping", 3, 2, True, 4)], "item_id long, error_message string, failed_at_stage string, below_080 int, below_070 int, needs_review boolean, av_failed int")
    got = [(r.severity, r.category) for r in A.anomalies(df).orderBy("rule").collect()]
    assert got == [("critical", "item_state"), ("warning", "item_state"), ("critical", "episodes"), ("warning", "episodes"), ("critical", "av_sync")]


def test_prune_plan_is_minimal(spark):
    rnd = random.Random(2)
    e = [(f"n{i}", rnd.randint(1, 50), rnd.randint(0, 30)) for i in range(100)]
    got = {r.name for r in RT.prune_plan(spark.createDataFrame(e, "name string, bytes long, cached_at long"), 900).collect()}
    total, want = sum(x[1] for x in e), set()
    for n, b, _ in sorted(e, key=lambda x: (x[2], x[0])):
        if total <= 900:
            break
        want.add(n)
        total -= b
    assert got == want


def test_file_tree(spark, tmp_path):
    for d, f, body in (("one", "a.bin", b"x" * 70_000), ("one", "sub/b.bin", b"y"), ("two", "a.bin", b"x" * 70_000), ("two", "sub/b.bin", b"y"), ("three", "c", b"z")):
        (tmp_path / d / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / d / f).write_bytes(body)
    inv = {r.name: (r.bytes, r.files) for r in FS.directory_inventory(FS.list_files(spark, str(tmp_path))).collect()}
    assert inv == {"one": (70_001, 2), "two": (70_001, 2), "three": (1, 1)}
    h = {r.name: r.manifest for r in FS.manifest_hash(FS.list_files(spark, str(tmp_path), content=True), cap=65_536).collect()}
    assert h["one"] == h["two"] != h["three"]
    (tmp_path / "two" / "a.bin").write_bytes(b"x" * 65_536 + b"w" * 4_464)
    again = {r.name: r.manifest for r in FS.manifest_hash(FS.list_files(spark, str(tmp_path), content=True), cap=65_536).collect()}
    assert again["two"] == h["two"]
    full = {r.name: r.manifest for r in FS.manifest_hash(FS.list_files(spark, str(tmp_path), content=True)).collect()}
    assert full["one"] != full["two"]


def test_key_catalogue_file(spark, tmp_path):
    i = "ab" * 20
    (tmp_path / "keys.cfg").write_text(f"; note\n0x{i} | First | x\nshort | T\n{i.upper()}|VOL_NAME (Nice Name)|y\n{'cd' * 20}|JFK (Director's Cut)\n{'ef' * 20}|Film (Film)\n")
    got = {r.disc_id: r.title for r in C.read_key_catalogue(spark, str(tmp_path)).collect()}
    assert got == {i.upper(): "Nice Name", "CD" * 20: "JFK (Director's Cut)", "EF" * 20: "Film"}
