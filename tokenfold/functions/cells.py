"""Cell and token expressions (native columns, one set per notation dialect)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenfold.functions import vocabulary as V

_SPACE = " \t\n\r\f"
_AA = V.AMINO_ACIDS
_SUBST_WORD = r"^([A-Za-z*]+)(\d+)([A-Za-z*]+)$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def norm_cell(c: Column, null_policy: str = "em") -> Column:
    """Trimmed upper-case cell; what counts as wild type depends on the policy.

    ``em``: null is wild type, an empty string is a mutation. ``v47``: a fixed
    list of spellings is wild type. ``jh``: null, empty, WT and MISSING are no
    mutation. ``jyp``: a fixed list of spellings is the separate MISSING state.
    """
    if null_policy == "em":
        return F.upper(strip(F.coalesce(c, F.lit("WT"))))
    up = F.upper(strip(F.coalesce(c, F.lit(""))))
    if null_policy == "v47":
        return F.when(up.isin(V.V47_WILD_TYPE), "WT").otherwise(up)
    if null_policy == "jh":
        return F.when(up.isin(V.JH_NON_MUTATION), "WT").otherwise(up)
    if null_policy == "jyp":
        return F.when(up.isin(V.JYP_MISSING), "MISSING").otherwise(up)
    raise ValueError(f"unknown null policy {null_policy!r}")


def raw_tokens(cell: Column) -> Column:
    """Whitespace-separated tokens, order and repeats kept."""
    return F.filter(F.split(strip(cell), r"\s+"), lambda t: t != "")


def split_tokens(cell: Column) -> Column:
    """Distinct upper-case tokens of a cell; a wild-type cell has none."""
    up = norm_cell(cell)
    none = F.array().cast("array<string>")
    return F.when(up.isin("", "WT", "<NA>"), none).otherwise(F.array_distinct(raw_tokens(up)))


def norm_token_jh(t: Column) -> Column:
    """Drop ``p.``, upper-case, full-width star to ``*``, legacy ``A12X`` to ``A12*``."""
    up = F.translate(F.upper(F.regexp_replace(strip(t), r"^(?i:p)\.\s*", "")), "＊", "*")
    return F.regexp_replace(up, r"^([A-Z])(\d+)X$", "$1$2*")


def norm_token_jyp(t: Column) -> Column:
    """Upper-case with lower-case indel words; missing spellings become MISSING."""
    up = F.upper(strip(t))
    stop = F.regexp_replace(up, rf"^([{_AA}X])(\d+)X$", "$1$2*")
    text = stop
    for word in ("DEL", "INS", "DUP", "FS"):
        text = F.replace(text, F.lit(word), F.lit(word.lower()))
    return F.when(up.isin(V.JYP_MISSING), "MISSING").when(up == "WT", "WT").otherwise(text)


def norm_token_jsj(t: Column) -> Column:
    """Drop ``p.``, ``?`` to X, ``=`` to the first letter; splice, ext and dup are wild type."""
    s = strip(t)
    body = F.when(s.startswith("p."), F.substring(s, 3, 1 << 20)).otherwise(s)
    body = F.translate(body, "?", "X")
    body = F.when(body.contains("="), F.replace(body, F.lit("="), F.substring(body, 1, 1))).otherwise(body)
    return (
        F.when(s.isin("", "nan", "None", "WT"), "WT")
        .when(F.lower(body).rlike("splice|ext|dup"), "WT")
        .otherwise(body)
    )


def cell_severity(cell: Column) -> Column:
    """0 wild type, 1 synonymous, 2 mutated, 3 in-frame or complex, 4 truncating."""
    up = norm_cell(cell)
    return (
        F.when(up.rlike(r"FS|\*|TER"), 4)
        .when(up.rlike(r"DEL|INS|DUP|>"), 3)
        .when(up.rlike(r"^([A-Z])\d+\1$"), 1)
        .when(up != "WT", 2)
        .otherwise(0)
    )


def consequence4(t: Column) -> Column:
    up = F.upper(strip(t))
    return (
        F.when(up.rlike(r"^([A-Z])\d+\1$"), 1)
        .when(up.rlike(r"FS|\*|TER"), 4)
        .when(up.rlike(r"DEL|INS|DUP|>"), 3)
        .otherwise(2)
    )


def consequence5(t: Column) -> Column:
    up = F.upper(strip(t))
    return (
        F.when(up.rlike(r"^([A-Z])\d+\1$"), 1)
        .when(up.contains("FS"), 5)
        .when(up.rlike(r"\*|TER$|X$"), 4)
        .when(up.rlike(r"DEL|INS|DUP|>|_"), 3)
        .otherwise(2)
    )


def protein_position(t: Column) -> Column:
    """First integer of the token, null without one."""
    digits = F.regexp_extract(t, r"(\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def parse_event_jh(t: Column) -> Column:
    """Struct (exact_event, consequence, position, aa_from, aa_to) of one token."""
    e = norm_token_jh(t)
    pos = protein_position(e)
    left = F.regexp_extract(e, r"^([A-Z])", 1)
    right = F.regexp_extract(e, r"^[A-Z]\d+([A-Z*=])$", 1)
    indel = e.rlike("DEL|INS|DUP")
    fs = e.contains("FS")
    simple = ~fs & ~indel & (right != "")
    to = F.when(right == "=", left).otherwise(right)
    kind = (
        F.when(fs, "FRAMESHIFT")
        .when(indel, "COMPLEX")
        .when(right == "*", "STOP")
        .when((right != "") & (to == left), "SYNONYMOUS")
        .when(right != "", "MISSENSE")
        .when(pos.isNotNull(), "OTHER")
        .otherwise("UNPARSED")
    )
    return F.struct(
        e.alias("exact_event"),
        kind.alias("consequence"),
        pos.alias("position"),
        F.when((simple | fs) & (left != ""), left).alias("aa_from"),
        F.when(simple, to).alias("aa_to"),
    )


def parse_event_jyp(t: Column) -> Column:
    """Consequence class of a normalised token."""
    up = F.upper(t)
    indel = up.rlike("DEL|INS|DUP")
    return (
        F.when(up.endswith("X") & (indel | up.contains("FS")), "COMPLEX")
        .when(up.contains("FS"), "FRAMESHIFT")
        .when(indel, "COMPLEX")
        .when(up.rlike(rf"^[{_AA}X]\d+\*$"), "STOP")
        .when(up.rlike(rf"^([{_AA}])\d+(\1|=)$"), "SYNONYMOUS")
        .when(up.rlike(rf"^[{_AA}]\d+[{_AA}]$"), "MISSENSE")
        .when(up.rlike("SPLICE|FUSION|AMP"), "OTHER")
        .otherwise("UNPARSED")
    )


def aa_transition(t: Column) -> Column:
    """``A>B`` of a substitution, stop or synonymous token, else null."""
    up = F.upper(t)
    left = F.regexp_extract(up, rf"^([{_AA}])\d+([{_AA}*=])$", 1)
    right = F.regexp_extract(up, rf"^([{_AA}])\d+([{_AA}*=])$", 2)
    return F.when(left != "", F.concat(left, F.lit(">"), F.when(right == "=", left).otherwise(right)))


def cell_state(cell: Column) -> Column:
    """MUTATED if any event, else MISSING if any missing token, else WT."""
    toks = F.transform(raw_tokens(F.coalesce(cell, F.lit(""))), norm_token_jyp)
    return (
        F.when(F.exists(toks, lambda t: ~t.isin("WT", "MISSING")), "MUTATED")
        .when((F.size(toks) == 0) | F.array_contains(toks, "MISSING"), "MISSING")
        .otherwise("WT")
    )


def jsj_body(t: Column) -> Column:
    return F.when(t.startswith("p."), F.substring(t, 3, 1 << 20)).otherwise(t)


def event_type_jsj(t: Column, version: int = 1) -> Column:
    """Eight event types; version 2 folds DUP into INS and knows SYN."""
    low = F.lower(t)
    head = F.when(low.contains("delins"), "DELINS").when(low.contains("fs"), "FS").when(low.contains("del"), "DEL")
    if version == 1:
        return (
            head.when(low.contains("ins"), "INS")
            .when(low.contains("dup"), "DUP")
            .when(t.contains("*") | low.contains("stop"), "STOP")
            .when(t.contains(">"), "SUB")
            .otherwise("OTHER")
        )
    left = F.regexp_extract(t, _SUBST_WORD, 1)
    right = F.regexp_extract(t, _SUBST_WORD, 3)
    return (
        head.when(low.rlike("ins|dup"), "INS")
        .when(t.contains("*") | t.endswith("X") | low.contains("stop"), "STOP")
        .when((left != "") & (left == right), "SYN")
        .when((left != "") | t.contains(">"), "SUB")
        .otherwise("OTHER")
    )


def aa_runs_jsj(t: Column) -> Column:
    """Runs of amino-acid letters (with X and ``*``) of a safe token."""
    return F.regexp_extract_all(t, F.lit(f"([{_AA}X*]+)"), 1)


def kind_jsj(t: Column) -> Column:
    """FS, STOP, MISSENSE, SILENT or WT of a safe token by its first and last run."""
    low, runs = F.lower(t), aa_runs_jsj(t)
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    ends = (F.length(t) >= 2) & first.rlike(f"[{_AA}]") & last.rlike(f"[{_AA}]")
    same = F.when(F.size(runs) >= 2, F.get(runs, F.lit(0)) == F.get(runs, F.size(runs) - 1)).otherwise(
        ends & (first == last)
    )
    return (
        F.when(t == "WT", "WT")
        .when(low.rlike("fs|ins|del"), "FS")
        .when(t.contains("*"), "STOP")
        .when(t.contains(">"), "MISSENSE")
        .when(same, "SILENT")
        .otherwise("MISSENSE")
    )


def flags_f(t: Column) -> dict[str, Column]:
    """Exclusive event kind (splice, frameshift, nonsense, missense) and free flags."""
    up = F.upper(t)
    splice = up.rlike(r"SPLICE|SPL_|IVS|[+-]\d+")
    fs = up.contains("FS")
    nonsense = up.rlike(r"\*|TER$|STOP")
    missense = up.rlike(r"^[A-Z*]\d+[A-Z*]$") & ~up.rlike(r"^([A-Z*])\d+\1$") & ~nonsense
    kind = (
        F.when(splice, "splice").when(fs, "frameshift").when(nonsense, "nonsense").when(missense, "missense")
        .otherwise("other")
    )
    return {"kind": kind, "truncating": fs | nonsense, "missense": missense, "splice": splice}


def functional_flag(t: Column) -> Column:
    return ~F.lower(t).rlike("synonymous|silent|intron")


def bin_of(value: Column, edges: list, names: list[str]) -> Column:
    """Name of the first bin whose upper edge is not exceeded."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, names):
        out = out.when(value <= edge, name)
    return out.otherwise(names[-1])


def position_bin(pos: Column, scheme: str = "jyp") -> Column:
    edges, names = V.POSITION_BINS[scheme]
    pos = F.when(pos >= 1, pos) if scheme == "jyp" else pos
    return bin_of(pos, edges, names)


def burden_bin(n: Column) -> Column:
    return bin_of(n, *V.BURDEN_BINS)
