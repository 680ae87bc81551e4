"""doc_ids at the ends of their range, beside null ones."""

import pytest
from test_llm import brute_components, brute_substring

LOW, HIGH = -(1 << 63), (1 << 63) - 1
TEXT = " ".join(f"w{k}" for k in range(60))
OTHER = " ".join(f"o{k}" for k in range(60))


@pytest.mark.parametrize("ids", [(LOW, 5, HIGH), (LOW, None, 5), (None, HIGH, 5), (LOW, HIGH), (None, 0)])
def test_substring_dedup(spark, ids):
    from loomlog.llm.substring_dedup import substring_dedup

    rows = [(i, f"{i} {TEXT} end{i}") for i in ids]
    place = {i: k for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0)))}
    want = {n: rest for n, *rest in brute_substring([(place[i], t) for i, t in rows])}
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [r.n_words, r.n_removed, r.kept_sha256] for r in got} == {i: want[place[i]] for i in ids}


@pytest.mark.parametrize("ids", [(LOW, 5, HIGH), (HIGH, None, 5), (LOW, None, 5), (None, 0)])
def test_jaccard_components(spark, ids):
    from loomlog.llm.jaccard_join import jaccard_components

    rows = [(ids[0], TEXT), (ids[1], TEXT + " x"), *[(i, OTHER) for i in ids[2:]]]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    place = {i: k for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0)))}
    back = {k: i for i, k in place.items()}
    want = brute_components([(place[i], t) for i, t in rows])
    assert got == {i: back[want[place[i]]] for i in ids}
