import hashlib

import pytest

from tabularium.llm import fingerprints as fp
from tabularium.llm import queries
from tabularium.session import table


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + other[:half]
        a, b, c = (fp.Sum.of(fp.paragraphs(x)) for x in (t, edited, other))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.text(), b.text(), a.likeness(b), a.likeness(c)))
    return sorted(out)


def test_sums_are_order_free_and_incremental():
    a = fp.Sum.of(["x", "y", "y", "z"])
    assert a.text() == fp.Sum.of(["y", "z", "x", "y"]).text() != fp.Sum.of(["x", "y", "z"]).text()
    assert (a - fp.Sum.of(["y"])).text() == fp.Sum.of(["x", "y", "z"]).text()
    assert (a + fp.Sum.of(["q"])).text() == fp.Sum.of(["q", "x", "y", "y", "z"]).text()
    assert fp.Sum.read(a.text()).likeness(a) == 1.0
    half = fp.Sum.of([f"p{i}" for i in range(20)]).likeness(fp.Sum.of([f"p{i}" for i in range(10, 30)]))
    assert 0.2 < half < 0.5 and fp.Sum.of(["a"]).likeness(fp.Sum.of(["b"])) < 0.1


@pytest.mark.parametrize("n", [10, 1000, 20_000, 100_000])
def test_likeness_follows_the_share_of_common_paragraphs_at_any_length(n):
    base = [f"line {i}" for i in range(n)]
    own = fp.Sum.of(base)
    for share in (0.1, 0.5):
        changed = int(n * share)
        after = own.edited(base, [f"new {i}" for i in range(changed)] + base[changed:])
        want = (n - changed) / (n + changed)
        assert abs(own.likeness(after) - want) < 0.12
    assert own.likeness(fp.Sum.of(f"other {i}" for i in range(n))) < 0.1
    assert own.likeness(own + fp.Sum.of(["one more"])) >= n / (n + 1) - 0.02


def test_likeness_counts_repeated_paragraphs_as_often_as_they_occur():
    a, b = [""] * 1000 + [f"a{i}" for i in range(1000)], [""] * 1000 + [f"b{i}" for i in range(1000)]
    assert abs(fp.Sum.of(a).likeness(fp.Sum.of(b)) - 1 / 3) < 0.1


def test_trial_against_brute_force(spark):
    rows = [(i * 11 % 101, "é" * (i % 7) + f"\nline {i}\n" * (i % 5)) for i in range(100)] + [(500, None), (501, ""), (502, "x" * 5000)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, tail string").repartition(4)
    for size in (1 << 23, 50):
        assert sorted(tuple(r) for r in fp.edit_trial(df, range_bytes=size).collect()) == brute(rows)


def test_single_empty_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert [tuple(r) for r in fp.edit_trial(df).collect()] == brute([(1, "ab")])
    assert fp.edit_trial(df.limit(0)).collect() == [] and fp.fingerprints(df.limit(0)).collect() == []
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "cd"), (None, "efgh"), (None, "efgh")], "doc_id long, text string")
    out = fp.edit_trial(df).collect()
    assert len(out) == 5 and {r.edited_sha256 for r in out if r.doc_id == 2} == {hashlib.sha256(b"ca").hexdigest()}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    out = queries.op5_fingerprints(spark, folder).collect()
    assert sorted(tuple(r) for r in out) == brute(rows)
    assert sum(r.near_edited for r in out) > 3 * sum(r.near_next for r in out)
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(table(spark, folder, "documents")).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in out}
