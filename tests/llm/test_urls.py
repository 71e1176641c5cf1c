import random

import duckdb
import pytest

from palaver.llm import urls as U


def compared(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = U.op3_url_filters(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(U.SQL)
    assert got.columns == want.columns
    got, want = sorted(map(tuple, got.collect()), key=repr), sorted(want.fetchall(), key=repr)
    assert got == want
    return got


def made(seed=1, n=1500):
    rng = random.Random(seed)
    hosts = ["a.example.com", "www.example.com", "example.com", "EXAMPLE.net", "b.net", "c.org", "com", "net", "xcom"]
    paths = ["/en/", "/fr/", "/es/", "/", "", "/en", "/shop/", "//", "/en//"]
    ends = lambda: rng.choice(["", str(rng.randrange(900)), f"{rng.randrange(900)}.html", f"post-{rng.randrange(60)}", "deadbeef01", "a/b/c/d/e", "x.PHP", "?q=1", "#f", "?a=://b"])
    return [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{ends()}", None) for i in range(n)]


def test_equals_sql(spark, tmp_path):
    got = compared(spark, tmp_path, made())
    assert all(any(mark in r[-1] for r in got) for mark in ("{w}", "{m:", "{n}", "{rest}"))


def test_nulls_repeats_and_empty(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", None), (3, "no scheme", None), (None, "http://b.net/es/1", None), (4, "http://b.net/es/1", None), (4, "http://b.net/es/1", None), (5, "x\n://H\n/p", None), (6, "http://" + "h" * 9000 + "/" + "p/" * 9000, None)]
    got = {r[0]: r for r in compared(spark, tmp_path, rows)}
    assert got[1][1:5] == got[3][1:5] == ("", "", None, "allow")
    assert got[4][1:5] == ("b.net", "/es/1", "net/es/", "block")
    df = spark.createDataFrame(rows[3:5], "page_id long, url string, html string").selectExpr("*", "1 host", "2 template", "3 n", "4 segments")
    assert U.verdicts(df).count() == 2 and U.verdicts(df.limit(0)).count() == 0


@pytest.mark.parametrize("url, rule, verdict", [("http://www.example.com/en/1", "www.example.com/en/", "allow"), ("http://m.example.com/en/1", "example.com/en/", "block"), ("http://example.com/en", "com/", "allow"), ("http://example.com", None, "allow"), ("http://a.net/fr/", "net/fr/", "block"), ("http://xnet/fr/", None, "allow")])
def test_longest_rule(spark, url, rule, verdict):
    r = U.verdicts(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.rule, r.verdict) == (rule, verdict)


def test_pure_templates_reject_unlisted_urls(spark):
    rules = [("bad.org", f"/x/{i}/", "block") for i in range(40)]
    rows = [(i, f"http://bad.org/x/{i}/p") for i in range(60)] + [(100 + i, f"http://good.org/x/{i}/p") for i in range(60)]
    got = {r.page_id: r.verdict for r in U.verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[100 + i] for i in range(60)} == {"allow"}


def test_similar_branches_share_their_labels(spark):
    """Unlabelled branches built as the blocked ones are; another of the host is built otherwise."""
    rng = random.Random(4)
    end = lambda: rng.choice([f"{rng.randrange(900)}", f"{rng.randrange(900)}.html", f"{rng.randrange(900)}/"])
    rows = [f"http://a.net/{lang}/{end()}" for lang in ("es", "fr", "en", "de") for _ in range(40)]
    rows += [f"http://a.net/about/us/team/{i}.PHP" for i in range(40)] + [f"http://b.org/{lang}/{end()}" for lang in ("en", "de") for _ in range(40)]
    got = U.verdicts(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    said = lambda host, first: {r.verdict for r in got if r.host == host and r.path.startswith(f"/{first}/")}
    assert said("a.net", "en") == said("a.net", "de") == {"block"} and said("a.net", "about") == {"allow"}
    assert said("b.org", "en") == said("b.org", "de") == {"allow"}
    assert {r.template.split("/")[1] for r in got if r.path.startswith("/en/")} == {"{m:{n}}"}


def test_branches_merge_at_any_depth(spark):
    deep = "/x/y/z/u/v"
    rows = [f"http://a.net{p}{deep}/{k}/{i}" for p in ("/es", "/en") for k in ("one", "two", "three") for i in range(20)]
    got = U.verdicts(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {r.template for r in got} == {"a.net/{m:{w}}/x/y/z/u/v/{m:{n}}/{n}"} and {r.verdict for r in got} == {"block"}


def test_jobs_follow_branchings_not_depth(spark):
    def jobs(depth):
        rows = [f"http://a.net/es{'/x' * depth}/{i}/p{'/y' * depth}" for i in range(3)] + [f"http://b.org{'/z' * depth}"] * 2
        tracker, group = spark.sparkContext.statusTracker(), f"depth-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = U.verdicts(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r.template for r in got if r.host == "a.net"} == {f"a.net/es{'/x' * depth}/{{n}}/p{'/y' * depth}"}
        assert {r.template for r in got if r.host == "b.org"} == {f"b.org{'/z' * depth}"}
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(200) <= jobs(5)


def test_deep_paths_that_part_equal_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"http://{rng.choice('ab')}.net/{rng.choice(['es', 'en'])}/" + "/".join(rng.choice("xy") if rng.random() < 0.2 else "x" for _ in range(rng.randrange(7))), None) for i in range(400)]
    compared(spark, tmp_path, rows)
