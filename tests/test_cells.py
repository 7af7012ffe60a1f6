"""Hand-derived values of the cell and token rules."""

import pytest
from pyspark.sql import functions as F

from tokenfold.functions import cells as C
from tokenfold.operators import events as E
from tokenfold.operators import genes as G
from tokenfold.operators import patterns as P


def values(frame, expr, *inputs):
    df = frame("i int, t string", *enumerate(inputs)).orderBy("i")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


@pytest.mark.parametrize("policy,expected", [
    ("em", ["WT", "", "WT", "MISSING", "R175H", "NAN"]),
    ("v47", ["WT", "WT", "WT", "MISSING", "R175H", "WT"]),
    ("jh", ["WT", "WT", "WT", "WT", "R175H", "NAN"]),
    ("jyp", ["MISSING", "MISSING", "WT", "MISSING", "R175H", "MISSING"]),
])
def test_null_policies(frame, policy, expected):
    got = values(frame, lambda c: C.norm_cell(c, policy), None, "", " wt ", "Missing", " r175h", "nan")
    assert got == expected


def test_split_tokens_are_distinct(frame):
    got = values(frame, C.split_tokens, "WT R175H R175H", "R175H\tR248Q", None, "WT", "")
    assert got == [["WT", "R175H"], ["R175H", "R248Q"], [], [], []]


def test_severity_later_rule_wins(frame):
    got = values(frame, C.cell_severity, None, "WT", "R175H", "A1A", "E746_A750del", "K16fs", "R213*", "A1A R2H")
    assert got == [0, 0, 2, 1, 3, 4, 4, 2]


def test_consequences(frame):
    tokens = ["A1A", "K16fs", "R213*", "R213X", "E746_A750del", "A1>B", "R175H", "Q5TER", "c.1_2"]
    assert values(frame, C.consequence5, *tokens) == [1, 5, 4, 4, 3, 3, 2, 4, 3]
    assert values(frame, C.consequence4, *tokens) == [1, 4, 4, 2, 3, 3, 2, 4, 2]


def test_parse_event_jh(frame):
    tokens = ["p.R175H", "R213X", "K16fs", "E746_A750del", "A1=", "A1A", "splice12", "amp", "R213＊"]
    got = [tuple(r) for r in values(frame, C.parse_event_jh, *tokens)]
    assert got == [
        ("R175H", "MISSENSE", 175, "R", "H"), ("R213*", "STOP", 213, "R", "*"), ("K16FS", "FRAMESHIFT", 16, "K", None),
        ("E746_A750DEL", "COMPLEX", 746, None, None), ("A1=", "SYNONYMOUS", 1, "A", "A"), ("A1A", "SYNONYMOUS", 1, "A", "A"),
        ("SPLICE12", "OTHER", 12, None, None), ("AMP", "UNPARSED", None, None, None), ("R213*", "STOP", 213, "R", "*")]


def test_jyp_dialect(frame):
    tokens = ["r175h", "R213X", "K16FS", "E7_A9DELINSX", "A1=", "A1A", "SPLICE", "odd", "NA", "wt"]
    norm = values(frame, C.norm_token_jyp, *tokens)
    assert norm == ["R175H", "R213*", "K16fs", "E7_A9delinsX", "A1=", "A1A", "SPLICE", "ODD", "MISSING", "WT"]
    kinds = values(frame, lambda c: C.parse_event_jyp(C.norm_token_jyp(c)), *tokens[:8])
    assert kinds == ["MISSENSE", "STOP", "FRAMESHIFT", "COMPLEX", "SYNONYMOUS", "SYNONYMOUS", "OTHER", "UNPARSED"]
    assert values(frame, C.aa_transition, "R175H", "A1=", "R2*", "K1fs") == ["R>H", "A>A", "R>*", None]


def test_jsj_dialect(frame):
    safe = values(frame, C.norm_token_jsj, "p.R175H", "R1?", "R1=", "splice", "R1ext", "A1dup", "WT")
    assert safe == ["R175H", "R1X", "R1R", "WT", "WT", "WT", "WT"]
    assert values(frame, C.kind_jsj, "R175H", "A1A", "K1fs", "R1*", "A>B", "WT", "12") == [
        "MISSENSE", "SILENT", "FS", "STOP", "MISSENSE", "WT", "MISSENSE"]
    assert values(frame, lambda c: C.event_type_jsj(c, 1), "A1delinsB", "K1fs", "A1del", "A1ins", "A1dup", "R1*", "A>B", "R1H") == [
        "DELINS", "FS", "DEL", "INS", "DUP", "STOP", "SUB", "OTHER"]
    assert values(frame, lambda c: C.event_type_jsj(c, 2), "A1dup", "R1X", "A1A", "R1H", "odd!") == ["INS", "STOP", "SYN", "SUB", "OTHER"]


def test_bins(frame):
    d = frame("p bigint", (0,), (50,), (51,), (1000,), (1001,), (None,))
    got = [r[0] for r in d.select(C.position_bin(F.col("p"), "jyp")).collect()]
    assert got == [None, "pos_1_50", "pos_51_100", "pos_501_1000", "pos_gt_1000", None]
    b = frame("n int", (0,), (5,), (6,), (16,), (33,), (34,)).select(C.burden_bin(F.col("n")))
    assert [r[0] for r in b.collect()] == ["0-5", "0-5", "6-9", "10-16", "17-33", "34+"]


def test_cell_state_and_missing(frame):
    got = values(frame, C.cell_state, None, "", "WT", "NA", "R175H NA", "WT NA")
    assert got == ["MISSING", "MISSING", "WT", "MISSING", "MUTATED", "MISSING"]


def test_wide_round_trip(frame):
    wide = frame("sample_id int, TP53 string, KRAS string", (1, "WT", "G12D"), (2, "R175H R248Q", None), (3, " wt", "WT"))
    got = {tuple(r) for r in E.to_cells(wide).collect()}
    assert got == {(1, "KRAS", "G12D"), (2, "TP53", "R175H R248Q")}
    kept = {tuple(r) for r in E.to_cells(wide, keep_null=True).collect()}
    assert kept == got | {(2, "KRAS", None)}


def test_profile_groups(frame):
    g1 = ["WT", "A1V", " a1v ", "WT", "WT", None, "NA"]
    g2 = ["WT", "WT", "WT", "A2X", "A2*", "WT", "WT"]
    cells = frame("sample_id int, gene string, cell string",
                  *[(i + 1, g, c) for g, col in (("G1", g1), ("G2", g2)) for i, c in enumerate(col)])
    samples = frame("sample_id int", *[(i,) for i in range(1, 8)])
    key = {r["sample_id"]: r["profile"] for r in P.profile_group(E.build_events(cells, "em5"), samples).collect()}
    assert key[1] == key[6] == "ALL_WT" and key[2] == key[3] and key[4] != key[5] and key[1] != key[7]
    assert len(set(key.values())) == 5


def test_pattern_key_ignores_order(frame):
    a = frame("sample_id int, gene string, cell string", (1, "A", "X1Y"), (1, "B", "R1H"), (2, "B", "r1h"), (2, "A", "X1Y "), (3, "A", "X1Y"))
    key = {r["sample_id"]: r["key"] for r in P.pattern_key(a, frame("sample_id int", (1,), (2,), (3,), (4,))).collect()}
    assert key[1] == key[2] != key[3] and key[4] == "ALL_WT"


def test_cell_code_digits_are_capped(frame):
    cell = " ".join(f"K{i}fs" for i in range(12)) + " R1H A1A"
    ev = E.build_events(frame("sample_id int, gene string, cell string", (1, "G", cell)), "jsj3")
    assert [r["code"] for r in E.cell_code(ev).collect()] == [9011]


def test_assemble_rejects_duplicates(frame):
    block = frame("sample_id int, feature string, value double", (1, "a", 1.0), (1, "a", 2.0))
    with pytest.raises(Exception, match="duplicate feature"):
        G.assemble({"b": block}).collect()
