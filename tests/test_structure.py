"""Components, cuts, layers, clusters, passages, markup: against plain versions on small and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import components, layout, markup, passages
from sparkquarry.store import Shelf


def graph(spark, edges, weighted=False):
    return spark.createDataFrame(edges, "src long, dst long, weight long" if weighted else "src long, dst long")


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    nodes = {n for e in edges for n in e}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return nodes, reach


def plain_components(edges):
    nodes, reach = closure(edges)
    return {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_equal_reachability(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * 1.1))] + [(7, 7), (100, 101), (101, 102), (102, 100)]
    odd = edges + [(None, 3), (4, None), edges[0]]
    got = components.strong_components(graph(spark, odd), Shelf(spark, "t")).collect()
    want = plain_components(edges)
    assert {x.node: x.component for x in got} == want and len(got) == len(want)
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(x["size"] == sizes[x.component] for x in got)


def test_a_long_ring_takes_few_rounds(spark):
    n = 5000
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = graph(spark, list(zip(order, order[1:] + order[:1])) + [(order[0], n)]).repartition(4)
    shelf, rounds = Shelf(spark, "ring"), []
    put = shelf.put
    shelf.put = lambda name, df: (rounds.append(name), put(name, df))[1]
    got = components.strong_components(edges, shelf)
    assert {(r.component, r["size"]) for r in got.select("component", "size").distinct().collect()} == {(0, n), (n, 1)}
    assert len(rounds) < 120  # tables of all rounds in both directions
    most = max(spark.read.parquet(f"{shelf.root}/{name}").count() for name in ("scc_out", "scc_edges"))
    assert most <= n + 1


def test_no_edges_no_components(spark):
    assert components.strong_components(graph(spark, []), Shelf(spark, "t")).count() == 0
    assert components.cut_edges(graph(spark, [], True), Shelf(spark, "t")).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_cuts_leave_no_cycle(spark, seed):
    r = random.Random(seed)
    edges = {(a, b): r.randint(1, 50) for a, b in ((r.randrange(15), r.randrange(15)) for _ in range(60))}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    cut = components.cut_edges(graph(spark, [*rows, (None, 1, 1), (1, 2, None), rows[0]], True), Shelf(spark, "t")).collect()
    gone = {(c.src, c.dst) for c in cut}
    assert len(gone) == len(cut) and gone <= set(edges)
    assert {c.src for c in cut if c.src == c.dst} == {a for a, b in edges if a == b}
    left = [e for e in edges if e not in gone]
    _, done = components.peel(graph(spark, left), Shelf(spark, "t"))
    assert done
    comp = plain_components(list(edges))
    assert all(comp[a] == comp[b] for a, b in gone)
    assert len(gone) < len(edges) / 2


def test_the_cheapest_edge_of_a_ring_is_cut(spark):
    cut = components.cut_edges(graph(spark, [(1, 2, 9), (2, 3, 2), (3, 1, 9)], True), Shelf(spark, "t")).collect()
    assert len(cut) == 1


def test_peel_sees_cycles(spark):
    layers, done = components.peel(graph(spark, [(1, 2), (2, 3), (1, 3)]), Shelf(spark, "t"))
    assert done and {r.node: r.layer for r in layers.collect()} == {1: 0, 2: 1, 3: 2}
    assert not components.peel(graph(spark, [(1, 2), (2, 1)]), Shelf(spark, "t"))[1]


def test_ranks_are_those_of_one_sort(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), r.randrange(1000), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, k long").repartition(7)
    got = layout.ranked(df, [F.col("a"), F.col("b"), F.col("k")], Shelf(spark, "t"), "r").collect()
    assert [(x.a, x.b, x.k) for x in sorted(got, key=lambda x: x["rank"])] == sorted(rows) and sorted(x["rank"] for x in got) == list(range(1, 3001))


def test_layers_of_a_graph_with_a_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("x", "d"), ("x", "x")]
    got = {r.node: (r.component, r.layer) for r in layout.layered(spark.createDataFrame(edges, "src string, dst string"), Shelf(spark, "t")).collect()}
    assert got == {"a": ("a", 0), "x": ("x", 0), "b": ("b", 1), "c": ("b", 1), "d": ("d", 2)}


def test_layers_look_for_components_only_where_peeling_leaves_edges(spark, monkeypatch):
    """Random graphs of chains, rings and self-loops against plain layers; a graph without cycles is peeled once, and components get only what cycles reach."""
    seen, plain = [], components.strong_components

    def watched(edges, *a, **k):
        seen.append({(r.src, r.dst) for r in edges.collect()})
        return plain(edges, *a, **k)

    monkeypatch.setattr(layout, "strong_components", watched)
    r = random.Random(5)
    down = [tuple(sorted(r.sample(range(40), 2))) for _ in range(90)] + [(k, k + 1) for k in range(100, 112)]
    rings = [(50, 51), (51, 52), (52, 50), (39, 50), (52, 53), (53, 54), (54, 53), (112, 60), (60, 61), (54, 61), (61, 61)]
    for edges in (down, down + rings):
        nodes, reach = closure(edges)
        comp = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
        layer = dict.fromkeys(nodes, 0)
        for _ in nodes:
            for a, b in edges:
                if comp[a] != comp[b]:
                    layer[b] = max(layer[b], layer[a] + 1)
            for n in nodes:
                layer[n] = max(layer[m] for m in nodes if comp[m] == comp[n])
        got = {x.node: (x.component, x.layer) for x in layout.layered(graph(spark, edges), Shelf(spark, "t"), sweeps=1).collect()}
        assert got == {n: (comp[n], layer[n]) for n in nodes}
    assert len(seen) == 1 and (50, 51) in seen[0] and not seen[0] & set(down) and (39, 50) not in seen[0]


# --- clusters and passages --------------------------------------------------------------------


def sequential(pairs):
    by = {}
    for a, b in sorted(set(pairs)):
        by.setdefault(a, {a}).add(b)
    kept = []
    for seed in sorted(by):
        if all(2 * len(by[seed] & k) <= min(len(by[seed]), len(k)) for _, k in kept):
            kept.append((seed, by[seed]))
    return {(s, m) for s, k in kept for m in k}


@pytest.mark.parametrize("seed", range(2))
def test_greedy_clusters_equal_the_sequential_ones(spark, seed):
    r = random.Random(seed)
    n = 50
    pairs = [tuple(sorted(r.sample(range(n), 2))) for _ in range(90)] + [(k, j) for k in range(60, 70) for j in range(k + 1, 70)]
    df = spark.createDataFrame([*pairs, pairs[0], (None, 3), (3, None)], "a long, b long")
    got = passages.greedy_clusters(df, Shelf(spark, "t")).collect()
    assert {tuple(x) for x in got} == sequential(pairs) and len(got) == len(sequential(pairs))


def test_chains_of_clusters_take_turns(spark):
    pairs = [(k, k + 1) for k in range(12)]
    assert {tuple(x) for x in passages.greedy_clusters(spark.createDataFrame(pairs, "a long, b long"), Shelf(spark, "t")).collect()} == sequential(pairs)
    assert passages.greedy_clusters(spark.createDataFrame([], "a long, b long"), Shelf(spark, "t")).count() == 0


def plain_passages(texts, n=6):
    places = {}
    lines = {d: [("" if not x.strip(" ") else x) for x in t.split("\n")] for d, t in texts}
    for d in sorted(lines):
        for i in range(len(lines[d]) - n + 1):
            w = tuple(lines[d][i : i + n])
            if any(w):
                places.setdefault(w, []).append((d, i + 1))
    refs = {(p[0][0], p[0][1], d, i) for p in places.values() for d, i in p if d != p[0][0]}
    out = set()
    for a, i, b, j in refs:
        if (a, i - 1, b, j - 1) not in refs:
            k = 0
            while (a, i + k, b, j + k) in refs:
                k += 1
            out.add((a, i, b, j, k + n - 1))
    return out


def test_copied_passages_equal_plain_search(spark):
    r = random.Random(6)
    lines = [f"line {k}" for k in range(40)]
    passage = [f"shared {k}" for k in range(9)]
    texts = []
    for d in range(40):
        body = r.choices(lines, k=r.randint(0, 15))
        if d % 3:
            at = r.randrange(len(body) + 1)
            body[at:at] = passage[: r.randint(4, 9)]
        texts.append((d, "\n".join(body)))
    texts += [(50, texts[7][1]), (51, "\n" * 20), (52, "\n" * 20), (53, "a\n\nb\n \nc\nd\ne"), (54, "x\na\n\nb\n\nc\nd\ne")]
    df = spark.createDataFrame([(d, t, "x") for d, t in texts] + [(None, texts[7][1], "x"), (60, None, "x"), (50, texts[7][1], "y")], "doc_id long, text string, Line string")
    got = passages.copied_passages(df).collect()
    assert {tuple(x) for x in got} == plain_passages(texts) and len(got) == len(plain_passages(texts))


def test_a_hot_passage_makes_a_row_for_each_text(spark):
    same = "\n".join(f"licence line {k}" for k in range(8))
    df = spark.createDataFrame([(k, f"{same}\nown {k}") for k in range(400)], "doc_id long, text string")
    got = passages.copied_passages(df).collect()
    assert len(got) == 399 and {x.length for x in got} == {8} and {x.doc_a for x in got} == {0}


# --- markup -----------------------------------------------------------------------------------


def plain_faults(text):
    stack, pairs, crossed, unopened, fault = [], 0, 0, 0, None
    line = col = 1
    for c in text or "":
        if c in markup.PAIRS:
            stack.append((line, col, c))
        elif c in markup.PAIRS.values():
            if stack:
                pairs += 1
                bad = markup.PAIRS[stack.pop()[2]] != c
                crossed += bad
            else:
                unopened += 1
                bad = True
            if bad and fault is None:
                fault = (line, col, c)
        line, col = (line + 1, 1) if c == "\n" else (line, col + 1)
    fault = fault or (stack[0] if stack else (None, None, None))
    return (pairs, crossed, unopened, len(stack), *fault)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 20])
def test_bracket_faults_equal_a_plain_scan(spark, chunk):
    r = random.Random(chunk)
    texts = ["".join(r.choice("()[]{}<>aé日\n") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", None, "((((", "))))", "(]", "<a>\n é<b>(x</b>)", "{[()]}", "((((]]]]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: tuple(x)[1:] for x in markup.bracket_faults(df, Shelf(spark, "t"), chunk=chunk).collect()}
    assert got == {k: plain_faults(t) for k, t in enumerate(texts)}


def test_a_long_text_is_linear():
    import time

    def seconds(n):
        raw = ("(a[b]{c}<d>)\n" * n).encode()
        began, place = time.process_time(), (0, 1, 1)
        for part in markup._chunks(raw, markup.CHUNK):
            left, *_, place = markup._reduce(part, *place)
        return time.process_time() - began

    seconds(1000)
    assert seconds(800_000) < 25  # 10 MB


def test_elements_of_malformed_pages(spark):
    pages = [
        (1, "<html><body><p>a<br>b<p>c</body></html>"),
        (2, "</div><a href='x'><b>t</a></b><i/>"),
        (3, None),
        (4, ""),
        (5, "<!-- <p> --><script>if (a<b) '</p>'</script><P><IMG src=x></p>"),
        (6, "<nav><ul><li><a>1</a><li><nav><a>2</a></nav></ul></nav><a>3</a>"),
        (7, "<p <x>"),
        (8, "<!-- open <p>"),
    ]
    nodes = markup.elements(spark.createDataFrame(pages, "page_id long, html string"))
    got = {}
    for x in nodes.orderBy("page_id", "node").collect():
        got.setdefault(x.page_id, []).append((x.node, x.parent, x.tag, x.depth, x["size"]))
    assert got[1] == [(0, None, "html", 0, 5), (1, 0, "body", 1, 4), (2, 1, "p", 2, 3), (3, 2, "br", 3, 1), (4, 2, "p", 3, 1)]
    assert got[2] == [(0, None, "a", 0, 2), (1, 0, "b", 1, 1), (2, None, "i", 0, 1)]
    assert got[5] == [(0, None, "script", 0, 1), (1, None, "p", 0, 2), (2, 1, "img", 1, 1)]
    assert set(got) == {1, 2, 5, 6, 7}
    links = sorted((x.ancestor, x.node) for x in markup.walk(nodes.filter("page_id = 6"), "nav", "a").collect())
    assert links == [(0, 3), (0, 6), (5, 6)]


def test_markup_workers_hold_few_rows(spark):
    """A batch of 3,000 pages of 40 elements, as Arrow may hand it over: results leave in parts, all of them, in order; the session's batches are bounded."""
    import pyarrow as pa

    class Pages:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    html = "<div>" + "<p>(a [b</p>" * 39 + "</div>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([html] * 3000)], ["a", "b"])
    for make, n in ((markup.elements, 40), (lambda p: markup.residues(p, "a", "b"), 79)):
        out = list(make(Pages())(iter([batch])))
        assert max(map(len, out)) < 2 * (1 << 14) and sum(map(len, out)) == 3000 * n
        assert [x for b in out for x in b.column(0).to_pylist()] == [k for k in range(3000) for _ in range(n)]
    assert list(markup.elements(Pages())(iter([batch.slice(0, 0)]))) == []
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
