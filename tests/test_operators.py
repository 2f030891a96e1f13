"""Literal cases of the rule tables."""

from pyspark.sql import functions as F

from sparkquarry.functions import semver
from sparkquarry.operators import complexity, debt, duplication, enrich, graph, packages, scan, source
from sparkquarry.sources import manifests
from sparkquarry.store import Shelf


def test_cyclomatic(spark):
    rows = [("f", 5, 0, False, 1), ("f", 10, 3, False, 2), ("f", 10, 0, True, 2), ("f", 60, 0, False, 3)]
    df = spark.createDataFrame(rows, "file_path string, lines long, params long, is_async boolean, want long").withColumn("name", F.lit("x"))
    assert all(r.cyclomatic == r.want for r in complexity.complexity(df).collect())


def test_ranges(spark):
    rows = [("3.2.1", "3.2.1", "exact"), ("4.0.0", ">3.9.9", "range"), ("3.9.9", ">3.9.9", "none"), ("3.2.1", ">=3.2.1", "range"), ("0.4.7", "^0.4.2", "range"), ("5.0.0", "^4.8.0", "none"), ("2.6.9", "~2.6.1", "range"), ("2.7.0", "~2.6.1", "none"), ("10.4.2", "10.*", "wildcard"), ("1.9.0", "<1.10.0", "range"), ("6.0.0", "7.0.0", "none")]
    df = spark.createDataFrame(rows, "v string, r string, want string").withColumn("got", semver.matches(F.col("v"), F.col("r")))
    assert [r.got for r in df.collect()] == [x[2] for x in rows]


def test_prerelease_order(spark):
    df = spark.createDataFrame([("1.0.0-alpha", "1.0.0", "prerelease"), ("1.0.0", "1.0.1", "patch"), ("1.0.0", "v2.0.0", "major"), ("1.1.0", "1.0.9", "none")], "a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", semver.update_type(F.col("a"), F.col("b"))).collect())


def test_advisories(spark):
    p = spark.createDataFrame([("parser", "2.3.9"), ("left", "1.0.0")], "package string, version string")
    a = spark.createDataFrame([("A1", "parser", "<2.4.0", 9.0)], "id string, package string, affected string, cvss double")
    (r,) = enrich.match_advisories(p, a).collect()
    assert (r.match, r.confidence, r.severity, r.priority) == ("range", 0.8, "critical", "urgent")


def test_cycles_and_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 2), (7, 8)], "src long, dst long")
    assert sorted(tuple(r.path) for r in graph.cycles(e).collect()) == [(1, 2, 3), (2, 3)]
    got = {r.node: r.component for r in graph.connected_components(e, Shelf(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.component for r in graph.connected_components(chain, Shelf(spark, "t")).collect()} == {0}


def test_depth_of_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (101, 100)], "src long, dst long")
    got = {r.node: r.depth for r in graph.bfs_depth(chain, Shelf(spark, "t")).collect()}
    assert got == {i: i for i in range(71)} | {100: 0, 101: 0}


def test_resolution_of_any_depth(spark):
    src = "import a from '../../z'\nimport b from './../sib.v2/deep'\nconst c = import('./lazy')\nimport q from '/abs'\nimport e from '../../../../../top'\nimport gone from './gone'"
    files = spark.createDataFrame([("/a/b/c/x.js", src), ("/a/z.ts", ""), ("/a/b/sib.v2/deep/index.js", ""), ("/abs.jsx", ""), ("/top.js", "")], "path string, content string")
    got = {r.source: r.target for r in source.resolved(source.imports(files).select("path", "source"), files).collect()}
    assert got == {"../../z": "/a/z.ts", "./../sib.v2/deep": "/a/b/sib.v2/deep/index.js", "/abs": "/abs.jsx", "../../../../../top": "/top.js"}
    assert ("import()", "./lazy") in {(r.how, r.source) for r in source.loads(files).collect()}


def test_functions_end_where_their_braces_close(spark):
    text = "export async function f(a, b = {x: 1}, c: T) {\n  if (a) {\n  }\n}\nconst g = (x) => x;\nconst open = function() {\n  y\n"
    rows = source.functions(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "path string, content string")).orderBy("start_line").collect()
    assert [(r.name, r.params, r.is_async, r.is_exported, r.start_line, r.end_line) for r in rows] == [("f", ["a", "b", "c"], True, True, 1, 4), ("g", ["x"], False, False, 5, 5), ("open", [], False, False, 6, 6)]


def test_cycles_of_any_length(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 12) for k in range(12)] + [(50, 51), (51, 50), (51, 3), (9, 60)], "src long, dst long")
    got = sorted((tuple(r.path), r.severity) for r in graph.shortest_cycles(ring, Shelf(spark, "t")).collect())
    assert got == [(tuple(range(12)), "critical"), ((50, 51), "medium")]
    assert graph.shortest_cycles(ring.filter("src = 9"), Shelf(spark, "t")).count() == 0


def test_tokens_pair_over_all_files(spark):
    rows = [(1, "f", "a b c d"), (2, "g", "a b c d"), (3, "g", "a b c x"), (4, "h", "a  b c\nd e"), (5, "h", None), (6, "h", " "), (7, "k", "q r")]
    out = duplication.token_pairs(spark.createDataFrame(rows, "block_id long, file_path string, content string")).collect()
    assert [(r.a, r.b, r.copies_a, r.copies_b, r.jaccard) for r in out] == [(1, 4, 2, 1, 0.8)]


def test_urls_with_bad_words(spark):
    rows = [(1, "JavaScript:alert(1)"), (2, "https://x.org/a;b`c"), (3, "ftp://x.org"), (4, "https://x.org/${y}"), (5, "https://x.org/ok"), (6, None)]
    got = {r.id: r.reason for r in scan.url_check(spark.createDataFrame(rows, "id long, url string")).collect()}
    assert got == {1: "malicious", 2: None, 3: "malicious", 4: "malicious", 5: None, 6: None}


def test_debt_depends_on_the_path(spark):
    rows = [(p, "f", 60, 0, False, "low", 1.0) for p in ("/x/service/a.js", "/x/component/b.js", "/x/util/c.js", "/x/d.js", None)]
    df = spark.createDataFrame(rows, "file_path string, name string, lines long, params long, is_async boolean, level string, weighted double")
    got = {r.file_path: r.change_frequency for r in debt.scored_items(debt.function_items(df)).collect()}
    assert got == {"/x/service/a.js": 0.6, "/x/component/b.js": 0.5, "/x/util/c.js": 0.2, "/x/d.js": 0.3, None: 0.3}
    classes = spark.createDataFrame([("f", "A", 55, 10), ("f", "B", 16, 10), ("f", "C", 1, 800), ("f", "D", 1, 1)], "file_path string, name string, methods long, lines long")
    assert sorted((r.name, r.item, r.severity) for r in debt.class_items(classes).collect()) == [("A", "large_class", "high"), ("A", "too_many_methods", "medium"), ("B", "too_many_methods", "medium"), ("C", "large_class", "medium")]


def test_manifest(spark):
    text = '{"name": "app", "dependencies": {"a": "^1.0.0", "b": "1"}, "devDependencies": {"b": "2"}}'
    rows = manifests.declared(manifests.manifests(spark.createDataFrame([(text,), ("broken",)], "content string")))
    assert sorted((r.package, r["range"], r.kind, r.weight) for r in rows.collect()) == [("a", "^1.0.0", "dependencies", 1.0), ("b", "2", "devDependencies", 0.5)]
    lock = '{"packages": {"": {"version": "0"}, "node_modules/runner": {"version": "5.0.2", "dev": true}}}'
    assert [(r.package, r.version, r.dev) for r in packages.lock_v2(spark.createDataFrame([(lock,)], "content string")).collect()] == [("runner", "5.0.2", True)]


def test_structural_clusters_need_similar_contents(spark):
    rows = [(1, "unrelated words here"), (2, "x"), (3, None), (4, "one two three four."), (5, "one two three five."), (6, "one two three four."), (7, "é é é é é é é é é é, a"), (8, "é é é é é é é é é é, b"), (9, "same; same"), (10, "same; same")]
    rows += [(100 + i, "a (b) " + chr(97 + i // 26) + chr(97 + i % 26)) for i in range(150)] + [(500 + i, f"long common text of a large cluster ; {i:04d} ;") for i in range(150)]
    df = spark.createDataFrame([(i, "f", t) for i, t in rows], "block_id long, file_path string, content string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    groups = {}
    for i, t in rows:
        if t is not None:
            groups.setdefault("".join(c for c in t if c in "{}[]();,."), []).append((i, t.encode()))
    want = set()
    for members in groups.values():
        alike = [1 - distance(a, b) / max(len(a), len(b)) for k, (_, a) in enumerate(members) for _, b in members[:k]]
        if alike and sum(alike) / len(alike) >= 0.85:
            want.add((len(members), members[0][0], members[-1][0], round(sum(alike) / len(alike), 6)))
    assert {(r.n, r.first_block, r.last_block, r.similarity) for r in duplication.similar_clusters(df).collect()} == want
    assert {w[1] for w in want} == {4, 7, 9, 500}


def test_tokens_without_comments(spark):
    from sparkquarry.operators import scan

    rows = [(1, "let x1 = 'a b' + 3.14; // y\n/* z\n z */ f(2)"), (2, "// only"), (3, ""), (4, None), (5, "a/*b*/c"), (6, "http://x.y/z w")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: (r.n, r.f) for r in df.select("id", scan.token_count(df.t).alias("n"), scan.tokenised(df.t).alias("f")).collect()}
    assert got[1] == (8, "IDENTIFIER IDENTIFIER = STRING_LITERAL + NUMBER_LITERAL; IDENTIFIER(NUMBER_LITERAL)")
    assert [got[k][0] for k in (2, 3, 4, 5, 6)] == [0, 0, 0, 1, 1] and got[4][1] is None


def test_endpoints(spark):
    from sparkquarry.operators import scan

    df = spark.createDataFrame([(1, "see https://a.b/c?d=1 and <a href='/x'> <img src=\"/x\"><form action=\"rel\"> https://a.b/c?d=1"), (2, None), (3, "none")], "id long, t string")
    assert sorted(tuple(r) for r in scan.endpoints(df, "t").collect()) == [(1, "endpoint", "/x", 2), (1, "url", "https://a.b/c?d=1", 2)]


def test_outlook_and_files(spark):
    from sparkquarry.operators import testability

    rows = [("f", "c", "a", 55.0, 4, True, 2, 1, 5), ("f", "c", "b", 85.0, 0, False, 0, 2, 5), ("g", None, "d", 30.0, 1, False, 4, 0, 5)]
    df = spark.createDataFrame(rows, "file_path string, class_name string, name string, score double, params long, is_async boolean, mocks long, external long, cyclomatic long")
    looked = testability.outlook(df)
    got = {r.name: (r.coverage, r.risk, r.hours, r.approach) for r in looked.collect()}
    assert got == {"a": (19.0, "high", 15, "unit_testing_with_mocks"), "b": (85.0, "low", 2, "pure_unit_testing"), "d": (0.0, "critical", 14, "integration_testing_with_test_doubles")}
    files = {r.file_path: (r.score, r.tested, r.untested, r.complexity, r.mocks, r.gaps, r.priority) for r in testability.by_file(looked).collect()}
    assert files == {"f": (70.0, 1, 1, 50, 2, 2, "medium"), "g": (30.0, 0, 1, 10, 4, 0, "critical")}
    plan = testability.strategy(looked, spark.createDataFrame([("critical",), ("low",), ("low",)], "band string")).first()
    assert (plan.n, plan.gate, plan.hours, plan.weeks, plan.approach, plan.immediate_weeks, plan.short_weeks) == (3, "fail", 40, 1, "risk_driven_testing_with_immediate_critical_focus", 2, 1)


def test_unused_exports(spark):
    from sparkquarry.operators import source

    files = [("/a.js", "import { used } from './b';\nimport * as all from './c.js';\nimport D from './d';"), ("/b.js", "export const used = 1;\nexport const idle = 2;"), ("/c.js", "export const any = 1;"), ("/d.js", "export default D\nexport const named = 1;"), ("/e.js", None)]
    got = {(r.path, r.name) for r in source.unused_exports(spark.createDataFrame(files, "path string, content string").filter("content is not null")).collect()}
    assert got == {("/b.js", "idle"), ("/d.js", "named")}


def _shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_near_copies_send_their_tokens_once(spark):
    """Token pairs equal plain counting; near copies neither meet once for each token nor send their sets once for each pair."""
    import random

    r = random.Random(3)
    base = [f"token{k:04d}{r.random()}" for k in range(300)]
    texts = [" ".join(r.sample(base, 270) + [f"own{k}x{j}" for j in range(k % 12)]) for k in range(240)] + [f"a b c{k % 3}" for k in range(9)] + ["x", "x y", " \n "]
    rows = spark.createDataFrame([(k, "f", t) for k, t in enumerate(texts)] + [(300, "f", None), (None, "f", "x y z")], "block_id long, file_path string, content string").repartition(4)
    key = "spark.sql.autoBroadcastJoinThreshold"
    small = spark.conf.get(key)
    spark.conf.set(key, "-1")  # large tables are not broadcast either
    before = _shuffled(spark)
    try:
        found = {(p.a, p.b): (p.copies_a, p.copies_b, p.jaccard) for p in duplication.token_pairs(rows).collect()}
    finally:
        spark.conf.set(key, small)
    sent = _shuffled(spark) - before
    sets = {}
    for k, t in enumerate(texts):
        sets.setdefault(frozenset(t.split()), []).append(k)
    sets = {min(ks): (s, len(ks)) for s, ks in sets.items() if s}
    want = {}
    for a in sets:
        for b in sets:
            n, u = len(sets[a][0] & sets[b][0]), len(sets[a][0] | sets[b][0])
            if a < b and 100 * n >= 75 * u:
                want[a, b] = (sets[a][1], sets[b][1], round(n / u, 6))
    assert found == want and len(want) > 7_000
    assert sent < 16 << 20, sent


def _long_texts(spark):
    """Rows of long texts that share many tokens, the least frequent too, but are alike only in families of eight; and their sets."""
    import random

    r = random.Random(5)
    base = [f"token{k:04d}{r.random()}" for k in range(4000)]
    sets = []
    for _ in range(15):
        first = r.sample(base, 2000)
        sets += [set(first[:1900]) | set(r.sample(base, 10 + 90 * (k % 2))) for k in range(8)]
    rows = [(k, "f", " ".join(sorted(x))) for k, x in enumerate(sets)]
    return spark.createDataFrame(rows, "block_id long, file_path string, content string").repartition(4), sets


def _sent(spark, act):
    """What act returns, and the bytes shuffled by it where nothing is broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    small = spark.conf.get(key)
    spark.conf.set(key, "-1")
    before = _shuffled(spark)
    try:
        return act(), _shuffled(spark) - before
    finally:
        spark.conf.set(key, small)


def test_long_unlike_texts_send_no_sets(spark):
    """Sketches grow with the sets, so pairs of long texts that only share rare tokens are ruled out before sets are sent."""
    rows, sets = _long_texts(spark)
    found, sent = _sent(spark, lambda: {(p.a, p.b): p.jaccard for p in duplication.token_pairs(rows).collect()})
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 100 * len(x & y) >= 75 * len(x | y)}
    assert found == want and len(want) == 15 * 28
    assert sent < 16 << 20, sent


def test_sketches_of_different_widths_lose_no_pair(spark):
    """Sets on both sides of a width of sketches, and parts of sketches and cells of sets that are small, give the pairs of plain counting."""
    sets = [set(range(k)) for k in range(470, 560, 6)] + [{-1 - x for x in range(k)} for k in range(1000, 1060, 9)] + [set(range(2000, 2000 + k)) for k in (3, 4, 5, 2030, 2060, 2700)]
    rows = spark.createDataFrame([(k, "f", " ".join(map(str, x))) for k, x in enumerate(sets)], "block_id long, file_path string, content string")
    want = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 100 * len(x & y) >= 75 * len(x | y)}
    now = duplication.CELL, duplication.CELL_BYTES, duplication.SKETCHED
    duplication.CELL, duplication.CELL_BYTES, duplication.SKETCHED = 4, 1 << 10, 10
    try:
        found = {(p.a, p.b): p.jaccard for p in duplication.token_pairs(rows).collect()}
    finally:
        duplication.CELL, duplication.CELL_BYTES, duplication.SKETCHED = now
    assert found.keys() == want.keys() and len(want) > 100
    assert all(abs(found[p] - want[p]) < 1e-6 for p in want)


def test_greedy_clusters_of_long_texts_send_no_sets(spark):
    from sparkquarry.operators import passages

    rows, sets = _long_texts(spark)
    found, sent = _sent(spark, lambda: {(r.cluster, r.member) for r in passages.greedy_clusters(duplication.token_pairs(rows), Shelf(spark, "t")).collect()})
    assert found == {(8 * k, 8 * k + x) for k in range(15) for x in range(8)}
    assert sent < 16 << 20, sent


def test_distances_by_bit_vectors_equal_the_table():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(1)
    for _ in range(500):
        a, b = (bytes(r.choices(b"abc\xc3\x00", k=r.randint(0, 90))) for _ in range(2))
        near = a[: len(a) // 3] + b[:4] + a[len(a) // 2 :]
        assert duplication.levenshtein(a, b) == plain(a, b) and duplication.levenshtein(a, near) == plain(a, near)


def test_distances_of_many_pairs_equal_the_vectors():
    import random

    r = random.Random(4)
    a = [bytes(r.choices(b"abc\0", k=r.randint(0, 120))) for _ in range(1500)] + [b"", b"", b"x" * 900]
    b = [x[: r.randint(0, 40)] + bytes(r.choices(b"abc\0", k=r.randint(0, 9))) + x[r.randint(20, 50) :] if r.random() < 0.7 else bytes(r.choices(b"abc\0", k=r.randint(0, 120))) for x in a[:1500]] + [b"", b"abc", b"x" * 450 + b"y" + b"x" * 449]
    assert duplication.distances(a, b).tolist() == [duplication.levenshtein(x, y) for x, y in zip(a, b)]
    assert duplication.distances([], []).tolist() == []


def test_unlike_contents_are_not_compared_in_all_pairs(spark, monkeypatch):
    """A cluster of unlike contents is ruled out by half as many distances as it has contents; clusters near the limit keep their exact means, with copies."""
    import random

    import pandas as pd
    from pyspark.sql import functions as F

    r = random.Random(6)
    word = lambda n: "".join(r.choices("abcdefghij ", k=n))
    groups = [[word(80) for _ in range(200)]]
    for g in range(1, 7):  # from like to unlike around the limit
        first = word(70)
        groups.append([";" * g + first[: r.randint(0, 10)] + word(g * 5) + first[10 + g :] for _ in range(10 + g)] + [";" * g + first] * g)
    rows = [(k, "f", t) for k, t in enumerate(t for g in groups for t in g)]
    seen = spark.sparkContext.accumulator(0)
    plain = duplication.levenshtein

    def counted():
        @F.pandas_udf("long")
        def of(a: pd.Series, b: pd.Series) -> pd.Series:
            seen.add(len(a))
            return pd.Series([plain(bytes(x), bytes(y)) for x, y in zip(a, b)], dtype="int64")

        return of

    monkeypatch.setattr(duplication, "distance", counted)
    df = spark.createDataFrame(rows, "block_id long, file_path string, content string")
    found = {(p.n, p.first_block): p.similarity for p in duplication.similar_clusters(df).collect()}
    want, at = {}, 0
    for g in groups:
        b = [x.encode() for x in g]
        sims = [1 - plain(x, y) / max(len(x), len(y)) for k, x in enumerate(b) for y in b[:k]]
        if sum(sims) / len(sims) >= 0.85:
            want[len(g), at] = sum(sims) / len(sims)
        at += len(g)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want) and 0 < len(want) < 6
    assert seen.value < 2000, seen.value


def test_components_send_no_labels_through_the_driver(spark):
    """Small tables too are joined by shuffle: what Spark takes for small at size would be broadcast from the driver in each round."""
    plans = []

    class Watched(Shelf):
        def put(self, name, df, *a):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().put(name, df, *a)

    e = spark.createDataFrame([(k, k + 1) for k in range(20)], "src long, dst long")
    assert {r.component for r in graph.connected_components(e, Watched(spark, "t")).collect()} == {0}
    assert sum("SortMergeJoin" in p for p in plans) > 1 and not any("Broadcast" in p for p in plans)


def test_six_sources_read_texts_only_for_their_tables(spark):
    """Once for the functions and their measures, once for the clusters; all else reads tables without texts."""
    from sparkquarry.plans import quality

    text = quality.Q["quality_recommendations_by_source"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in text and "documents.parquet" not in text
