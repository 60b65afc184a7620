import hashlib
import re
from collections import defaultdict

import pytest

from confab.llm import exact_dedup
from tests.llm.support import SPACE, awkward, table


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t, _) in enumerate(rows):
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for bare, own in groups.items():
        best = min(own)
        for x in own:
            d = rows[x[3]][0]
            out.append((d, rows[best[3]][0], len(own), x[3] == best[3], hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kw", [{}, {"block_chars": 7}, {"block_chars": 16, "hash_bits": 2}])
def test_groups_match_brute_force(spark, kw):
    rows = [*awkward(), (None, "no id", "z"), (None, None, None)]
    got = exact_dedup.exact_groups(table(spark, rows), **kw)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []
    assert exact_dedup.deduplicated(table(spark, [])).collect() == []


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    docs = table(spark, awkward())
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    want = {(d, bare) for d, _, _, kept, bare in brute(awkward()) if kept}
    rows = got.collect()
    assert len(rows) == len(want)
    assert {r.doc_id for r in rows} == {d for d, _ in want}


def test_names_do_not_depend_on_partitions(spark):
    rows = [*awkward(), *((100 + i, f"hot {i % 3}", None) for i in range(400))]
    one, many = ({tuple(map(str, r)) for r in exact_dedup.identities(table(spark, rows).repartition(n), block_chars=16).collect()} for n in (1, 7))
    assert one == many
    got = exact_dedup.exact_groups(table(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_one_shared_first_block_fills_no_bucket(spark, monkeypatch):
    """3,000 texts of two blocks that begin alike: their pairs are dealt over the buckets, and all are told apart."""
    seen, ranked = {}, exact_dedup.ranked

    def spy(rows, order, bucket, label):
        seen[label] = [r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()]
        return ranked(rows, order, bucket, label)

    monkeypatch.setattr(exact_dedup, "ranked", spy)
    rows = [(i, "h" * 40 + f"{i:040d}", None) for i in range(3000)] + [(5000, " ".join("h" * 40 + f"{7:040d}"), None)]
    got = exact_dedup.exact_groups(table(spark, rows), block_chars=40).collect()
    assert sorted(r.doc_id for r in got if not r.kept) == [7] and {r.group_size for r in got if r.doc_id in (7, 5000)} == {2}
    assert sum(seen["pairs1"]) == 3000 and max(seen["pairs1"]) < 15
