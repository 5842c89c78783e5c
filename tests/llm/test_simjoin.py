"""The similarity join against all pairs in plain Python."""

import re
from collections import defaultdict

from tidewater.llm import graph, simjoin

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """``(n, component)`` per row, in order."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for a, b in {(a, b) for v in where.values() for a in v for b in v if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(b)] = find(a)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return [(r.doc_id, len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def check(docs):
    want = sorted(brute(docs.collect()), key=str)
    got = sorted(map(tuple, simjoin.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_documents(documents):
    check(documents)


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_chains_families_and_a_common_passage(spark):
    common = " ".join(f"shared{i}" for i in range(40))
    rows = [(i, f"{common} " + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(40)]
    base = [f"b{j}" for j in range(120)]
    rows += [(100 + i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(0, 60, 2)]
    chain = [f"c{j}" for j in range(200)]
    rows += [(200 + i, " ".join(chain[5 * i : 5 * i + 60])) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty(empty_docs):
    assert simjoin.near_duplicates(empty_docs).count() == 0


def test_keep_one_leaves_a_document_of_each_component(documents):
    want = {c for _, _, c in brute(documents.collect())}
    kept = simjoin.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 50), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 50, 200: 50, 50: 50}
