import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from stratus.llm.entry import OP9_SQL, op9_url_filter
from stratus.llm.url_filter import host_of, intervals, path_of, temporal_filter

D = dt.date


def test_hosts(spark):
    urls = {"https://A.Example.com:80/x/y": ("a.example.com", "x"), "http://u@b.org": ("b.org", ""), "ftp://c.net.?q": ("c.net", ""),
            "nothing": (None, ""), None: (None, ""), "": (None, ""), "https:///x": (None, "x"), "x://h/#a": ("h", "")}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: (r.h, r.p) for r in df.select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p")).collect()}
    assert got == urls


def plain(captures, entries):
    def active(key, day):
        known = [e for e in entries if e[1] and e[2] and e[3] and e[0] is not None and e[1].lower() == key and e[3] <= day]
        if not known:
            return None
        last = max(e[3] for e in known)
        best = sorted({(e[0], e[2]) for e in known if e[3] == last}, key=lambda x: (-ord(x[0][0]), x[1]))
        top = max(e[0] for e in best)
        entry = min((a for i, a in best if i == top))
        return None if entry == "unlist" else (top, entry)

    out = []
    for i, host, segment, day in captures:
        found = []
        if host and day:
            labels = host.split(".")
            keys = [(len(labels) - k, ".".join(labels[k:])) for k in range(max(1, len(labels) - 1))]
            if segment:
                keys.append((1000, f"{host}/{segment}"))
            found = sorted((r, *a) for r, key in keys if (a := active(key, day)))
        out.append((i, len(found), found[-1][1] if found else None, found[-1][2] if found else None, not found or found[-1][2] != "block"))
    return out


def test_histories(spark):
    rng = random.Random(3)
    hosts = ["a.x.com", "b.x.com", "x.com", "www.a.x.com", "y.org", "z"]
    keys = [*hosts, "a.x.com/p", "X.com", None]
    entries = [(rng.choice("abcdefgh"), rng.choice(keys), rng.choice(["block", "allow", "unlist", None]),
                rng.choice([None, *[D(2024, 1, 1) + dt.timedelta(rng.randrange(40)) for _ in range(9)]])) for _ in range(120)]
    entries += entries[:20]
    captures = [(rng.choice([None, 1, 2, 3]), rng.choice([*hosts, None]), rng.choice(["", "p", "q"]),
                 rng.choice([None, *[D(2023, 12, 25) + dt.timedelta(rng.randrange(60)) for _ in range(9)]])) for _ in range(400)]
    c = spark.createDataFrame([(i, None if h is None else f"https://{h}/{s}", d, "e", 1) for i, h, s, d in captures], "page_id long, url string, fetched date, key string, `row` int")
    e = spark.createDataFrame(entries, "entry_id string, key string, action string, since date")
    got = sorted(((r.page_id, r.n_active, r.entry_id, r.action, r.kept) for r in temporal_filter(c, e).collect()), key=str)
    assert got == sorted(plain(captures, entries), key=str)
    spans = [r for r in intervals(e).collect()]
    assert all(r.since < r.until for r in spans)
    assert temporal_filter(c.limit(0), e).count() == 0
    assert temporal_filter(c, e.limit(0)).filter("kept").count() == len(captures)


def test_sql_gives_the_same(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = con.execute(OP9_SQL).fetchall()
    got = [tuple(r) for r in op9_url_filter(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_deeper_paths(spark):
    day = D(2024, 5, 1)
    entries = [("h", "x.com", "block", day), ("a", "x.com/a", "allow", day), ("b", "x.com/a/b", "block", day), ("c", "x.com/a/b/c.d/", "allow", day),
               ("s", "y.com/a//b/", "block", day), ("t", "com", "block", day)]
    want = {"http://x.com/z": "h", "http://x.com/a?/b": "a", "http://x.com/a/bb": "a", "http://x.com/a/b": "b", "http://x.com/a/b/#c.d": "b", "http://w.x.com/a/b": "h",
            "http://x.com/a/b/x/y": "b", "http://x.com/a/b/c.d/e?f": "c", "http://y.com/a//b/q": "s", "http://y.com/a/b": None, "http://com/a": "t"}
    c = spark.createDataFrame([(i, u, day) for i, u in enumerate(want)], "page_id long, url string, fetched date")
    e = spark.createDataFrame(entries, "entry_id string, key string, action string, since date")
    got = {r.page_id: r.entry_id for r in temporal_filter(c, e).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
