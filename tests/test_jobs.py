"""The jobs: against SQL on the smallest tables, against plain Python on small ones, over reruns and growing input (copies)."""

import json
import logging
import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from jobs import queries as q
from jobs import region_motifs, text_reuse
from jobs.common import options_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(df):
    cols = sorted(df.columns)
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


@have
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_job_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    relation = con.sql(q.oracle_sql()[name])
    assert sorted(relation.columns) == sorted(df.columns)
    at = [relation.columns.index(c) for c in sorted(df.columns)]
    want = Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in relation.fetchall())
    assert rows_of(df) == want and want


@pytest.mark.parametrize("job", [region_motifs, text_reuse])
def test_config_file_holds_the_defaults(spark, job):
    path = f"{ROOT}/jobs/{job.__name__.split('.')[1]}.json"
    assert options_of(spark, job.Options, path) == job.Options() == options_of(spark, job.Options, None)


def test_unknown_option_is_an_error(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"rarity": 1.0, "chromosomes": ["Chr1"]}))
    assert options_of(spark, region_motifs.Options, str(tmp_path / "c.json")) == region_motifs.Options(1.0, None, ("Chr1",))
    (tmp_path / "d.json").write_text(json.dumps({"rariti": 1.0}))
    with pytest.raises(ValueError, match="rariti"):
        options_of(spark, region_motifs.Options, str(tmp_path / "d.json"))


@have
def test_region_motifs_replaces_what_it_writes(spark, tmp_path, caplog):
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO, "jobs"):
        region_motifs.run(spark, SF, out)
    assert "motif hits" in caplog.text and "Chr3 of" in caplog.text
    first = rows_of(region_motifs.output(spark, out))
    region_motifs.run(spark, SF, out)
    assert rows_of(region_motifs.output(spark, out)) == first and len(first) > 100
    other = region_motifs.Options(rarity=0.0, chromosomes=("Chr2",))
    for _ in range(2):
        region_motifs.run(spark, SF, out, other)
    now = rows_of(region_motifs.output(spark, out))
    at = sorted(region_motifs.output(spark, out).columns).index("chrom")
    assert {r for r in now if r[at] != "Chr2"} == {r for r in first if r[at] != "Chr2"}
    assert sum(r[at] == "Chr2" for r in now) == sum(r[at] == "Chr2" for r in first) and now != first


def test_region_motifs_on_small_tables(spark):
    hits = spark.createDataFrame([("a", "Chr1", 10, 14), ("a", "Chr1", 12, 16), ("b", "Chr1", 20, 24), ("b", "Chr1", 500, 504), ("c", "Chr2", 5, 9), ("a", None, 1, 2), (None, "Chr1", 30, 34)], "motif string, chrom string, start_pos int, stop_pos int")
    regions = spark.createDataFrame([("r1", "Chr1", 1, 100), ("r2", "Chr2", 1, 100), ("r3", "Chr3", 1, 9)], "acr string, chrom string, start_pos int, stop_pos int")
    got = sorted((r.acr, r.pos, r.motif) for r in region_motifs.rows(hits, regions).collect())
    assert got == [("r1", 0, "a"), ("r1", 1, "b"), ("r2", 0, "c")]
    assert region_motifs.rows(hits.where("false"), regions).count() == 0 == region_motifs.rows(hits, regions.where("false")).count()
    assert {r.motif for r in region_motifs.rows(hits, regions, region_motifs.Options(least_z=0.0)).collect()} == {"c"}  # a: 2 of 5 in regions, 3 of 7 in all


WORDS = "river stone cloud garden winter music lamp bridge forest table window letter account number value".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def brute(docs, items, k=4, least=0.5):
    """Chains by comparing each text with each item, in plain Python."""

    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = Counter()
    for doc, t, lang in sorted(set(docs), key=str):
        own = grams(t)
        for item, u in sorted(set(items), key=str):
            known = grams(u)
            points = [(i, j) for i, x in enumerate(own) for j, y in enumerate(known) if x == y]
            best = 0
            for turn in (1, -1):
                length = []
                for n, (i, j) in enumerate(points):
                    length.append(1 + max((length[m] for m in range(n) if points[m][0] < i and points[m][1] * turn < j * turn), default=0))
                best = max([best, *length])
            if points and best / len(known) >= least:
                out[doc, item, lang or None, best, len(points), len(known)] += 1
    return out


def plain(df):
    return Counter((r.doc_id, r.item_id, r.lang, r.chain, r.n_anchors, r.n_runs) for r in df.collect())


DOCS, ITEMS = "doc_id long, text string, lang string, source string, acr string, motif string", "item_id long, text string, pos string"


def corpus():
    r = random.Random(5)
    items = [(i, text(r, r.randrange(4, 20))) for i in range(8)] + [(8, "too short here"), (9, None), (10, ""), (None, text(r, 9))]
    docs = []
    for i in range(40):
        t = text(r, r.randrange(0, 60)).split()
        if i % 3 == 0:
            own = (r.choice(items[:8])[1]).upper().split()
            own.insert(r.randrange(len(own)), "inserted")
            t[5:5] = own * r.choice((1, 1, 2))
        docs.append((i, "\t".join(t), r.choice(("en", "de", "", None))))
    docs += [(50, None, "en"), (51, "", None), (52, " \n ", "en"), (None, items[0][1], "en"), (3, docs[3][1], docs[3][2]), (53, (items[1][1] + " ") * 300, "fr")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "s", "a", "m") for d in docs], DOCS), spark.createDataFrame([(*i, "p") for i in items], ITEMS)


def test_reuse_equals_brute_force(spark):
    docs, items = corpus()
    d, k = frames(spark, docs, items)
    got = plain(text_reuse.reused(d, k))
    assert got == brute(docs, items) and len(got) > 10
    assert text_reuse.reused(d.where("false"), k).count() == 0 == text_reuse.reused(d, k.where("false")).count()


def test_reuse_takes_only_what_is_new(spark, tmp_path, caplog):
    docs, items = corpus()
    d, k = frames(spark, docs, items)
    texts, known, out, mark = (str(tmp_path / x) for x in ("texts", "known", "out", "mark"))
    k.write.parquet(known)
    d.where("doc_id < 20").write.parquet(texts)
    text_reuse.run(spark, texts, known, out, mark)
    first = plain(text_reuse.output(spark, out))
    assert first == brute([x for x in docs if x[0] is not None and x[0] < 20], items)
    d.where("doc_id is null or doc_id >= 20").write.mode("append").parquet(texts)
    with caplog.at_level(logging.INFO, "jobs"):
        text_reuse.run(spark, texts, known, out, mark)
    assert f"read {len([x for x in docs if x[0] is None or x[0] >= 20])} texts" in caplog.text
    second = text_reuse.output(spark, out)
    assert plain(second.where("batch = 0")) == first and plain(second) == brute(docs, items)
    held = rows_of(second)
    for _ in range(2):  # nothing new
        text_reuse.run(spark, texts, known, out, mark)
    assert rows_of(text_reuse.output(spark, out)) == held
    # a run that was lost between its rows and its mark: the batch runs again and replaces its own rows
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "mark" / name).unlink()
    with caplog.at_level(logging.INFO, "jobs"):
        text_reuse.run(spark, texts, known, out, mark)
    assert caplog.text.count("batch 1: read") == 2 and rows_of(text_reuse.output(spark, out)) == held
    # file by file; a row that repeats in other files counts in each of their batches
    text_reuse.run(spark, texts, known, str(tmp_path / "out2"), str(tmp_path / "mark2"), text_reuse.Options(files=1))
    assert set(plain(text_reuse.output(spark, str(tmp_path / "out2")))) == set(brute(docs, items))


def test_reuse_without_texts(spark, tmp_path):
    d, k = frames(spark, *corpus())
    texts, known, out = (str(tmp_path / x) for x in ("texts", "known", "out"))
    k.write.parquet(known)
    d.where("false").write.parquet(texts)
    text_reuse.run(spark, texts, known, out, str(tmp_path / "mark"))
    assert text_reuse.output(spark, out).count() == 0


@have
def test_command_line(tmp_path):
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.region_motifs", "--tables", SF, "--out", str(tmp_path / "out"), "--config", f"{ROOT}/jobs/region_motifs.json"], cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=4 pyspark-shell"}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "motif hits" in done.stderr and "Chr1 of" in done.stderr


def test_region_motifs_places_hits_once(spark):
    hits = spark.createDataFrame([("a", "Chr1", 5, 9), ("b", "Chr1", 30, 34)], "motif string, chrom string, start_pos int, stop_pos int")
    regions = spark.createDataFrame([("r", "Chr1", 1, 20)], "acr string, chrom string, start_pos int, stop_pos int")
    held = []
    found = region_motifs.rows(hits, regions, held=held)
    assert "last(region" not in found._jdf.queryExecution().executedPlan().toString() and len(held) == 2
    assert [(r.acr, r.motif) for r in found.collect()] == [("r", "a")]
