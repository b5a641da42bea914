from datetime import datetime

from jurisgrid.operators.orphans import RANGE, _bits, _pack, find_orphans

REFS = "fiche_id long, target string, table_name string, record_id long, created_at timestamp, extra string"
PARENTS = "fiche_id long, target string, first_loaded timestamp, deleted boolean"
T = lambda m, d=1: datetime(2024, m, d)


def test_states(spark):
    parents = spark.createDataFrame([(1, "a", T(1), False), (1, "b", T(1), True), (1, "c", T(5, 10), False), (2, "a", T(9), False), (None, "z", T(1), False)], PARENTS)
    refs = [(1, "a", "t", 1, T(3), ""), (1, "b", "t", 2, T(3), ""), (1, "c", "t", 3, T(5, 9), ""), (1, "c", "t", 4, T(5, 11), ""), (2, "a", "u", 5, T(3), ""), (3, "a", "t", 6, T(3), ""), (None, "a", "t", 7, T(3), ""), (1, None, "t", 8, T(3), ""), (1, "q", "t", 9, None, ""), (2, "a", "t", 10, None, "")]
    got = {r["record_id"]: (r["state"], r["table_name"]) for r in find_orphans(spark.createDataFrame(refs, REFS), parents, ["fiche_id", "target"]).collect()}
    assert got == {2: ("deleted", "t"), 3: ("late", "t"), 5: ("late", "u"), 6: ("missing", "t"), 9: ("missing", "t")}


def test_hot_key_and_empty(spark):
    parents = spark.createDataFrame([(1, "a", T(1), False)], PARENTS)
    refs = spark.createDataFrame([(1, "gone" if i % 3 else f"k{i}", "t", i, T(1 + i % 6), "") for i in range(900)], REFS)
    assert find_orphans(refs, parents, ["fiche_id", "target"]).count() == 900
    assert find_orphans(refs.limit(0), parents, ["fiche_id", "target"]).count() == 0
    assert find_orphans(refs, parents.limit(0), ["fiche_id", "target"]).count() == 900


def test_containers():
    for bits in ([], [0], [5, RANGE - 1], list(range(0, RANGE, 7))):
        raw = bytearray(RANGE // 8)
        for b in bits:
            raw[b // 8] |= 1 << (b % 8)
        assert [i for i, x in enumerate(_bits(_pack(bytes(raw)))) if x] == bits
    assert len(_pack(bytes(RANGE // 8))) == 1
