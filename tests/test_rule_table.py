"""URL rules as a table against a plain loop over all rules."""

import random
import re

import pytest

from docrecords.operators import rule_table as RT


@pytest.mark.parametrize(
    "pattern, runs",
    [
        ("https?://www.example", ["http", "://www", "example"]),
        ("/fr/", ["/fr/"]),
        ("https?://[^/]+/fr/", ["http", "://", "/fr/"]),
        (r"a\.b\dc", ["a.b", "c"]),
        ("ab+cd", ["ab", "cd"]),
        ("abc{0,2}d", ["ab", "d"]),
        ("x(?P<lang>.*?)/yz", ["x", "/yz"]),
        ("abc|def", []),
        ("(abc|def)ghi", ["ghi"]),
        ("", []),
        (None, []),
    ],
)
def test_required_literals(pattern, runs):
    assert RT.required_literals(pattern) == runs


def brute(urls, rules):
    out = []
    for page_id, url in urls:
        found = [o for o, p in rules if url is not None and p is not None and re.search(p, url)]
        starts = [o for o, p in rules if url is not None and p is not None and re.match(p, url)]
        out.append((page_id, min(found, default=None), min(starts, default=None)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def test_equals_a_loop_over_all_rules(spark):
    rng = random.Random(7)
    hosts = ["www.a.com", "blog.a.com", "b.org", "c.net", "www.b.org"]
    paths = ["/en/1", "/fr/2/", "/de/x.html", "/", "/en/fr/", "/?next=http://b.org/fr/"]
    urls = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)]
    urls += [(300, None), (301, ""), (302, urls[0][1]), (302, urls[1][1])]
    rules = [
        (5, "https?://www"),
        (3, "/fr/"),
        (9, "https?://blog"),
        (1, r"b\.org/fr/"),
        (4, "https?://[^/]+/de/"),
        (2, ".*html$"),  # names no literal of three characters: tested everywhere
        (7, "c.net|b.org"),  # alternatives: tested everywhere
        (6, "/en/"),
        (6, "www.b"),  # a shared ord
        (8, None),
        (0, "zzz-none"),
    ]
    url_df = spark.createDataFrame(urls, "page_id long, url string")
    got = RT.first_rules(url_df, spark.createDataFrame(rules, "ord long, pattern string")).collect()
    mine = sorted(((r["page_id"], r["found_ord"], r["start_ord"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0))
    assert mine == brute(urls, rules)


def test_no_rules_and_no_urls(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "ord long, pattern string")
    assert [tuple(r) for r in RT.first_rules(urls, none).collect()] == [(1, "http://a.com/", None, None)]
    assert RT.first_rules(urls.limit(0), spark.createDataFrame([(1, "a")], "ord long, pattern string")).count() == 0


def most_rows(plan):
    """Rows made by the node of an executed plan that made most."""
    kind, found = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = plan.children()
    inner += [children.apply(i) for i in range(children.size())]
    return max([found.get().value() if found.isDefined() else 0, *map(most_rows, inner)])


def one_host(n):
    """Pages of one host, each with its own copy of the same four rules."""
    langs = ["en", "fr", "de", "es"]
    urls = [(i, f"https://www.a-host.org/{langs[i % 3]}/{i}") for i in range(n)]
    return urls, [(4 * i + k, f"https://www.a-host.org/{lang}/") for i in range(n) for k, lang in enumerate(langs)]


def like_hosts(n):
    """A rule for every host; their names have the same pieces of three characters."""
    names = [f"0001011100{i:09b}0001011100".replace("0", "a").replace("1", "b") for i in range(n)]
    urls = [(i, f"https://{x}.org/{i}") for i, x in enumerate(names)]
    return urls, [(i, rf"https://{x}\.org/") for i, x in enumerate(names)]


@pytest.mark.parametrize("made", [one_host, like_hosts])
def test_rows_grow_with_the_tables(spark, made):
    rows = []
    for n in (100, 400):
        urls, rules = made(n)
        out = RT.first_rules(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "ord long, pattern string"))
        mine = sorted((r["page_id"], r["found_ord"], r["start_ord"]) for r in out.collect())
        first = {p: o for o, p in reversed(rules)}
        assert mine == brute(urls, [(o, p) for p, o in first.items()])
        rows.append(most_rows(out._jdf.queryExecution().executedPlan()))
    # four times the rows, not sixteen
    assert 0 < rows[1] <= 5 * rows[0], rows


def test_runs_of_every_length(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcé/.", k=rng.randint(0, 130))) for _ in range(60)]
    urls = list(enumerate(texts))
    rules = []
    for k in range(300):
        text = rng.choice(texts)
        at, size = rng.randrange(len(text) + 1), rng.choice([2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 23, 24, 30, 47, 48, 49, 90])
        rules.append((k * 7 % 300, "".join(rng.choice(["\\.", "."]) if c == "." else c for c in text[at : at + size])))
    got = RT.first_rules(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "ord long, pattern string"))
    assert sorted((r["page_id"], r["found_ord"], r["start_ord"]) for r in got.collect()) == brute(urls, rules)


def test_rules_without_a_key_are_counted_one_by_one(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.range(RT.UNKEYED_MAX + 1).selectExpr("id AS ord", "'a+' AS pattern")
    with pytest.raises(ValueError, match="without a literal"):
        RT.first_rules(urls, rules)
    assert RT.first_rules(urls, rules.filter("ord > 0")).first()["found_ord"] == 1
