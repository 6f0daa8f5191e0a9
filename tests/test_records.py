import json

import pytest
from pyspark.sql import functions as F

from fieldshift.functions.text import canonical_id, html_blocks
from fieldshift.operators import extract, identity, tokens
from fieldshift.sources import logs, standings, tables

PACKED = "Alpha||Orb|Blaze|Hit, Run,|Bold||M|||50|]Beta Two|nick| |Wave|Stand||||||5x|] "
LOG = "\n".join(
    [
        "|player|p1|ann|x",
        "|player|p2|bob|y",
        "|showteam|p1|Old||I|A|m|N",
        " |showteam|p1|" + PACKED,
        "|showteam|p2|Gamma||Orb|Blaze|Hit|Calm",
        "|win|ann",
    ]
)


def one(df):
    return df.first()[0]


def test_packed(spark):
    df = spark.createDataFrame([(PACKED,)], "t string")
    members = one(df.select(extract.parse_packed(F.col("t"))))
    assert [m["species"] for m in members] == ["Alpha", "Beta Two"]
    assert members[0]["moves"] == ["Hit", "Run"] and members[0]["level"] == 50 and members[0]["gender"] == "M"
    assert members[1]["item"] == "" and members[1]["level"] is None and members[1]["gender"] is None


def _battles(spark, log=LOG):
    return spark.createDataFrame([("b1", 100, "s", log)], "battle_id string, ts long, season string, log string")


def test_log_rosters(spark):
    got = {r["side"]: r for r in extract.rosters_of_logs(_battles(spark)).collect()}
    assert got["p1"]["won"] is True and got["p2"]["won"] is False and got["p2"]["player"] == "bob"
    assert len(got["p1"]["members"]) == 2  # the last shown team counts
    undecided = extract.rosters_of_logs(_battles(spark, LOG.replace("|win|ann", "|tie")))
    assert {r["won"] for r in undecided.collect()} == {None}


def test_pairings_need_one_winner(spark):
    schema = "battle_id string, side string, roster_id string, won boolean, members array<int>"
    full, short = [0] * 6, [0] * 5
    data = [
        ("ok", "p1", "a", False, full), ("ok", "p2", "b", True, full),
        ("tie", "p1", "c", True, full), ("tie", "p2", "d", True, full),
        ("open", "p1", "e", None, full), ("open", "p2", "f", None, full),
        ("half", "p1", "g", True, full), ("half", "p2", "h", False, short),
    ]
    got = extract.extract_pairings(spark.createDataFrame(data, schema)).collect()
    assert [tuple(r) for r in got] == [("ok", "a", "b", 0)]


EXPORT = """Nick (Alpha) (F) @ Orb
Ability: Blaze
Level: 50
EVs: 4 HP
Bold Nature
- Hit
- Run
-
- Three
- Four
- Five

Beta
Shiny: Yes

 @ Nothing

Gamma (M)
Level: x"""


def test_export(spark):
    df = spark.createDataFrame([(EXPORT,)], "t string")
    got = one(df.select(extract.parse_export(F.col("t"))))
    assert [m["species"] for m in got] == ["Alpha", "Beta", "Gamma"]
    assert got[0]["gender"] == "F" and got[0]["item"] == "Orb" and got[0]["nature"] == "Bold" and got[0]["level"] == 50
    assert got[0]["moves"] == ["Hit", "Run", "Three", "Four", "Five"]
    assert got[1]["item"] == "" and got[1]["ability"] == "" and got[2]["gender"] == "M" and got[2]["level"] is None


def test_html_blocks(spark):
    texts = ["<html><pre class='x'>A &amp; <b>B</b></pre><pre>C &#39;d&#39; &eacute;</pre></html>", "plain &lt;", "<p>none</p>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(html_blocks(F.col("t"), "pre")).collect()]
    assert got == ["A & B\n\nC 'd' é", "plain <", "<p>none</p>"]


def test_canonical_id(spark):
    df = spark.createDataFrame([("Mr. Mime-Galar",), ("",), (None,), ("Flabébé",)], "t string")
    assert [r[0] for r in df.select(canonical_id(F.col("t"))).collect()] == ["mrmimegalar", "unknown", "unknown", "flabébé"]


def test_native_files(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "logs_s1.json").write_text(json.dumps({"b1": [100, LOG], "b2": [200, "|start"]}))
    battles = logs.read_battle_logs(spark, str(folder))
    assert {(r["battle_id"], r["ts"], r["season"]) for r in battles.collect()} == {("b1", 100, "s1"), ("b2", 200, "s1")}
    assert logs.read_log_rosters(spark, str(folder), full_only=False).count() == 2
    deck = [{"id": "alpha", "name": "Alpha!", "item": "Orb", "ability": "Blaze", "attacks": ["Hit"], "nature": None}, {"item": "x"}]
    doc = {
        "tournament": {"id": "t", "name": "Cup", "date": "2024-01-01T12:00:00+02:00", "format": "f", "players": 3},
        "standings": [{"name": "Ann", "placing": 1, "decklist": deck}, {"name": "Bob", "placing": "x"}, {"name": "Cy", "decklist": [{"item": "y"}]}],
    }
    (tmp_path / "st.json").write_text(json.dumps(doc))
    rosters = extract.standing_rosters(standings.read_standings(spark, str(tmp_path / "st.json"))).collect()
    assert len(rosters) == 1 and rosters[0]["weight"] == 16.0 and rosters[0]["ts"] == 1704103200
    assert rosters[0]["player"] == "Ann" and [m["species"] for m in rosters[0]["members"]] == ["alpha"]
    (tmp_path / "ix.json").write_text('{"id":"t","date":"2024-01-01T00:00:00Z"}\n')
    assert tuple(standings.read_event_index(spark, str(tmp_path / "ix.json")).first()) == ("t", "", "2024-01-01T00:00:00Z", "", 0)


def _members(spark, rows):
    member = "struct<species:string,item:string,ability:string,moves:array<string>,nature:string>"
    return spark.createDataFrame(rows, f"seq long, members array<{member}>")


A = ("Alpha", "Orb", "Blaze", ["Run", "Hit"], "Bold")
A2 = ("Alpha", "Orb", "Blaze", ["Hit", "Run"], "Bold")
B = ("Beta", "", "Wave", ["Stand"], "Calm")


def test_hash_ignores_order_and_counts(spark):
    df = _members(spark, [(5, [A, B]), (1, [B, A2]), (9, [A]), (7, [A, B])])
    got = {r["seq"]: r["occurrence_count"] for r in identity.dedupe_rosters(df).collect()}
    assert got == {1: 3, 9: 1}
    keys = {r["seq"]: r["row_key"].split("-")[1] for r in identity.duplicate_row_keys(df).collect()}
    assert keys == {1: "1", 5: "2", 7: "3", 9: "1"}


def test_hash_value(spark):
    import hashlib

    sig = [{"ability": "Blaze", "item": "Orb", "moves": ["Hit", "Run"], "nature": "Bold", "species": "Alpha"}]
    want = hashlib.sha256(json.dumps(sig, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    df = _members(spark, [(1, [A])])
    assert one(df.select(identity.roster_hash(F.col("members")))) == want


def test_family_precedence_and_straddling(spark):
    df = _members(spark, [(1, [A, B]), (2, [("Pelipper", "", "Drought", [], "")]), (3, [("x", "", "a", ["Trick Room"], "")]), (4, [("x", "", "Driz", [], ""), ("y", "", "zle", [], "")])])
    got = {r[0]: r[1] for r in df.select("seq", tokens.classify_family(F.col("members"))).collect()}
    assert got == {1: "Balance", 2: "Sun", 3: "Trick Room", 4: "Rain"}


def test_encoding_pads_and_marks_unknown(spark):
    rows = [(1, 1, "Alpha", "Orb", "Blaze", ["Hit"], "Bold"), (1, 2, "Nobody", None, "", [], "Bold"), (2, 1, "Alpha", "New", "Blaze", [], "Bold")]
    members = spark.createDataFrame(
        rows, "roster_id long, slot int, species string, item string, ability string, moves array<string>, nature string"
    )
    dim = spark.createDataFrame([("alpha", ["Fire"], 45)], "id string, types array<string>, hp int")
    toks = tokens.token_rows(members, dim, ("hp",))
    texts = {(r["roster_id"], r["slot"], r["token"]) for r in toks.collect()}
    assert (1, 2, "base_stat:hp:0") in texts and (1, 2, "item:unknown") in texts and (1, 1, "type:fire") in texts
    vocab, kinds = tokens.stored_vocab(toks.where("roster_id = 1"))
    assert {r["token"]: r["id"] for r in vocab.collect()}["type:fire"] == 5
    enc = {r["roster_id"]: r for r in tokens.encode_tokens(toks, vocab, kinds).collect()}
    assert len(enc[1]["value_ids"]) == 12 and enc[1]["value_ids"][10] == 0 and enc[1]["attr_mask"][6]
    assert len(enc[2]["value_ids"]) == 6
    fixed = {r["roster_id"]: r for r in tokens.encode_tokens(toks, vocab, kinds, attr_size=15, team_size=6).collect()}
    assert len(fixed[2]["value_ids"]) == 90 and fixed[1]["value_ids"][14] == 0 and fixed[1]["attr_mask"][15]
    assert enc[2]["value_ids"][2] == tokens.UNK_ID
    masked = tokens.masked_examples(tokens.encode_tokens(toks, vocab, kinds)).collect()
    for r in masked:
        full = enc[r["roster_id"]]
        assert r["target_at"] in full["maskable_at"] and r["value_ids"][r["target_at"]] == tokens.MASK_ID
        assert r["target_value_id"] == full["value_ids"][r["target_at"]]
        assert [v for i, v in enumerate(r["value_ids"]) if i != r["target_at"]] == [
            v for i, v in enumerate(full["value_ids"]) if i != r["target_at"]
        ]


def test_exclude_owned_moves_candidates_by_roster_once(spark):
    """Candidates keep their place: they are not shuffled after they are offered, and nulls stay candidates."""
    from fieldshift.operators.recommend import exclude_owned

    held = spark.createDataFrame([(1, "A-1"), (1, "B"), (2, None), (None, "A-1")], "roster_id long, species string")
    offers = [(r, s, i) for i, (r, s) in enumerate([(1, "a1"), (1, "c"), (1, None), (2, "a1"), (3, "b"), (None, "a1")])]
    rows = exclude_owned(spark.createDataFrame(offers, "roster_id long, species_id string, n int"), held)
    assert rows.columns == ["roster_id", "species_id", "n"] and {r["n"] for r in rows.collect()} == {1, 2, 3, 4, 5}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        each = held.select("roster_id").distinct().select("roster_id", F.explode(F.array(F.lit("a1"), F.lit("c"))).alias("species_id"))
        plan = exclude_owned(each, held)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 2  # the rosters and the members


def test_cells_travel_as_numbers_and_large_ids_as_four(spark):
    """One number a cell where bases fit, four where they don't; neither a struct, and both as the tokens say."""
    rows = [(r, s, p, f"k{p % 2}", f"t{(r + s + p) % 5}", p % 2 == 1 if p else None) for r in range(40) for s in (1, 3) for p in range(3 if r else 1)]
    toks = spark.createDataFrame(rows, "roster_id long, slot int, pos int, kind string, token string, maskable boolean")
    kinds = spark.createDataFrame([("k0", 1), ("k1", 70000)], "kind string, kind_id int")
    for factor in (1, (1 << 31) // 8):
        vocab = spark.createDataFrame([(f"t{i}", 3 + i * factor) for i in range(4)], "token string, id int")
        kinds_ = kinds if factor > 1 else kinds.where("kind_id = 1")
        out = tokens.encode_tokens(toks, vocab, kinds_, attr_size=4)
        assert "named_struct" not in out._jdf.queryExecution().optimizedPlan().toString()
        for r in out.collect():
            held = {(s - 1) * 4 + p: (k, t, m) for i, s, p, k, t, m in rows if i == r["roster_id"]}
            ids = {f"t{i}": 3 + i * factor for i in range(4)}
            known = {"k0": 1, **({"k1": 70000} if factor > 1 else {})}
            assert r["attr_mask"] == [i in held for i in range(12)]
            assert r["value_ids"] == [ids.get(held[i][1], tokens.UNK_ID) if i in held else 0 for i in range(12)]
            assert r["kind_ids"] == [known.get(held[i][0], 0) if i in held else 0 for i in range(12)]
            assert r["maskable_at"] == [i for i in range(12) if i in held and held[i][2]]
    with pytest.raises(Exception, match="same place"):
        tokens.encode_tokens(toks.unionByName(toks), vocab, kinds).collect()


def test_rosters_are_written_compressed(spark, tmp_path):
    rows = [("1", "y1", "p", 5, 1.0, [("a", "b", "c", ["m"], "n", 3)])]
    member = "struct<species:string,item:string,ability:string,moves:array<string>,nature:string,level:int>"
    df = spark.createDataFrame(rows, f"roster_id string, season string, player string, ts long, weight double, members array<{member}>")
    tables.write_rosters(df, str(tmp_path / "r"))
    assert [f.name[-3:] for f in (tmp_path / "r").rglob("part-*")] == [".gz"]
    back = tables.read_rosters(spark, str(tmp_path / "r")).first()
    assert back["roster_id"] == "1" and back["season"] == "y1" and back["members"][0]["species"] == "a"


def test_codebook_fallback(spark, tmp_path):
    stats = spark.createDataFrame([([0.0], [1.0])], "mean array<double>, std array<double>")
    units = spark.createDataFrame([("unit", 0, [1.0])], "kind string, id int, vec array<double>")
    tables.write_codebook(stats, units, str(tmp_path / "cb"))
    _, back = tables.read_codebook(spark, str(tmp_path / "cb"))
    assert {r["kind"] for r in back.collect()} == {"unit", "anchor"}
    tables.write_codebook(stats, units.withColumn("kind", F.lit("anchor")), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        tables.read_codebook(spark, str(tmp_path / "bad"))


def test_large_rosters_are_encoded_whole(spark):
    rows = [(1, i, f"S{i}", "Orb", "Blaze", [f"m{k}" for k in range(i)], "Bold") for i in range(1, 14)]
    members = spark.createDataFrame(
        rows, "roster_id long, slot int, species string, item string, ability string, moves array<string>, nature string"
    )
    dim = spark.createDataFrame([("s13", ["A", "B", "C"], 45)], "id string, types array<string>, hp int")
    toks = tokens.token_rows(members, dim, ("hp",))
    assert toks.count() == 13 * 4 + 3 + sum(range(1, 14))
    vocab, kinds = tokens.stored_vocab(toks)
    ids = [r["id"] for r in vocab.collect()]
    assert sorted(ids) == list(range(len(ids)))
    enc = tokens.encode_tokens(toks, vocab, kinds).first()
    assert len(enc["value_ids"]) == 13 * 20 and sum(enc["attr_mask"]) == toks.count()
    assert tokens.token_rows(members, dim, ("hp",), team_size=6, attr_size=15).agg({"slot": "max"}).first()[0] == 6


def test_parse_export_takes_no_pattern_per_line(spark):
    """Lines are told apart by how they begin; only a member's item, nature and level meet a pattern, once each."""
    text = "\x0b Nick ( Rotom ) (F)  @ Leftovers \r\nABILITY: a\r\n-\tBolt\r- nature\n-\nLevel: x\nlevel: 50\rBold nature\n \t\n\nMew\nAbility: Nature\n"
    df = spark.createDataFrame([(text,)], "t string").select(extract.parse_export(F.col("t")).alias("m"))
    assert [tuple(m) for m in one(df)] == [
        ("Rotom", "Leftovers", "a", ["Bolt", "nature"], "Bold", 50, "F"),
        ("Mew", "", "Nature", [], "", None, None),
    ]
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("regexp_") + plan.count("rlike") <= 6 and "ability:" in plan and "^ability" not in plan


def test_rosters_of_logs_cut_only_lines_of_their_kind(spark):
    """Team lines are not cut at every bar, nor taken apart by patterns; a line may lack its opening bar."""
    log = "player|p1|ann|x\n|player|p2|bob\n|player|p2\n|showteam|p1|A||i|b|m,n\n|showteam|p2\n||player|p2|no\nwin|ann\n|win|"
    rows = spark.createDataFrame([("1", 5, "s", log), ("2", 6, "s", "|showteam|p9|Z")], "battle_id string, ts long, season string, log string")
    out = extract.rosters_of_logs(rows)
    got = {(r["battle_id"], r["side"]): (r["player"], r["won"], [m["species"] for m in r["members"]]) for r in out.collect()}
    assert got == {("1", "p1"): ("ann", None, ["A"]), ("1", ""): (None, None, []), ("2", "p9"): (None, None, ["Z"])}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract" not in plan and "regexp_replace" not in plan


def test_families_move_only_the_fields_of_their_rules(spark):
    """Item, nature and level are not shuffled for a family, moves travel as one text; the families are those of whole rosters."""
    from fieldshift.catalog import roles

    sf = "/root/testdata/sf0.001"
    got = roles.families(spark, sf)
    whole = roles.member_lists(spark, sf).select("roster_id", tokens.classify_family(F.col("members"), roles.RULES).alias("family"))
    assert sorted(got.collect()) == sorted(whole.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "p_type" not in plan and "l_linestatus" not in plan


def test_members_are_numbered_without_lists(spark):
    from fieldshift.catalog import roles

    sf = "/root/testdata/sf0.001"
    got = roles.members(spark, sf, "size")
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    lists = roles.member_lists(spark, sf).select("roster_id", F.size("members").alias("size"), F.posexplode("members").alias("pos", "m"))
    want = lists.select("roster_id", (F.col("pos") + 1).alias("slot"), "m.*", "size")
    assert got.dtypes == want.dtypes and got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
