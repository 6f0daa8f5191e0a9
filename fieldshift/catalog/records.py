"""Readers, parsers, projections, identity and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldshift.catalog import roles
from fieldshift.catalog.registry import query, rounded
from fieldshift.functions.periods import epoch_of_iso
from fieldshift.functions.text import canonical_id, html_blocks
from fieldshift.operators import extract, seasons, tokens
from fieldshift.operators.identity import dedupe_rosters, duplicate_row_keys, inspection_fields
from fieldshift.operators.recommend import exclude_owned, member_options, member_pool
from fieldshift.session import fresh_path, stage
from fieldshift.sources import logs, standings, tables

# --- sources and sinks ---

BATTLE = """WITH s AS (SELECT o_orderkey // 2 AS b, o_orderkey AS roster_id, 'p' || (o_orderkey % 2 + 1) AS side, 'c' || o_custkey AS player,
    o_orderstatus AS status, o_totalprice AS price, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders WHERE o_orderkey IN (SELECT roster_id FROM member)),
    w AS (SELECT b, CASE WHEN bool_or(status <> 'P') THEN arg_max(player, (price, player)) END AS winner, arg_min(ts, side) AS bts FROM s GROUP BY b),
    r AS (SELECT CAST(b AS VARCHAR) AS battle_id, side, player, bts AS ts, 'y' || year(make_timestamp(bts * 1000000)) AS season,
    CASE WHEN winner IS NOT NULL THEN player = winner END AS won, roster_id FROM s JOIN w USING (b))"""


@query(
    "read_battle_logs",
    BATTLE + " SELECT battle_id, any_value(ts) AS ts, any_value(season) AS season, count(*) AS sides FROM r GROUP BY battle_id",
    "member",
)
def read_battle_logs(spark, sf):
    path = fresh_path(spark, "logs")
    logs.write_battle_logs(roles.battle_logs(spark, sf), path)
    battles = logs.read_battle_logs(spark, path, one_map_per_file=False)
    return battles.select("battle_id", "ts", "season", F.regexp_count("log", F.lit(r"\|showteam\|")).cast("long").alias("sides"))


@query(
    "read_standings",
    """WITH d AS (SELECT o_custkey, o_orderkey // 1000 AS c, min(o_orderdate) AS d FROM orders WHERE o_orderkey IN (SELECT roster_id FROM member)
    GROUP BY ALL) SELECT CAST(orders.o_custkey AS VARCHAR) AS event_id, CAST(o_orderkey AS VARCHAR) AS player,
    CAST(floor(o_totalprice / 10000)::INTEGER AS VARCHAR) AS placing, strftime(d, '%Y-%m-%dT%H:%M:%SZ') AS date,
    CASE WHEN o_orderstatus <> 'P' THEN n_members ELSE 0 END AS deck FROM orders JOIN d ON d.o_custkey = orders.o_custkey
    AND d.c = o_orderkey // 1000 JOIN sized ON roster_id = o_orderkey""",
    "sized member",
)
def read_standings(spark, sf):
    rows = standings.read_standings(spark, roles.standings_json(spark, sf))
    return rows.select(
        F.col("event.id").alias("event_id"),
        "player",
        "placing",
        F.col("event.date").alias("date"),
        F.coalesce(F.size("decklist"), F.lit(0)).cast("long").alias("deck"),
    )


@query(
    "standing_to_roster",
    """WITH d AS (SELECT o_custkey, o_orderkey // 1000 AS c, min(o_orderdate) AS d FROM orders WHERE o_orderkey IN (SELECT roster_id FROM member)
    GROUP BY ALL), m AS (SELECT roster_id, string_agg(species || '/' || moves_text, ',' ORDER BY slot) AS t FROM member GROUP BY roster_id),
    p AS (SELECT *, floor(o_totalprice / 10000)::INTEGER AS rk FROM orders WHERE o_orderstatus <> 'P')
    SELECT CAST(p.o_custkey AS VARCHAR) AS source_id, CAST(o_orderkey AS VARCHAR) AS player, CAST(epoch(d) AS BIGINT) AS ts,
    (round(8 * CASE WHEN rk > 0 THEN 1 + 1.0 / rk ELSE 1 END, 6) + 0.0)::DOUBLE AS weight, t AS members FROM p
    JOIN d ON d.o_custkey = p.o_custkey AND d.c = o_orderkey // 1000 JOIN m ON roster_id = o_orderkey""",
    "member",
)
def standing_to_roster(spark, sf):
    rows = standings.read_standings(spark, roles.standings_json(spark, sf))
    out = extract.standing_rosters(rows)
    text = F.array_join(
        F.transform("members", lambda m: F.concat(m["species"], F.lit("/"), F.array_join(m["moves"], " "))), ","
    )
    return rounded(out.select("source_id", "player", "ts", "weight", text.alias("members")), "weight")


@query(
    "read_event_index",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || ' ' || c_mktsegment END AS name,
    strftime(d, '%Y-%m-%dT%H:%M:%SZ') AS date, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE n END AS players, '' AS format FROM customer
    JOIN (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS d FROM orders GROUP BY 1) q ON o_custkey = c_custkey""",
)
def read_event_index(spark, sf):
    path = fresh_path(spark, "event-index")
    key = F.col("id").cast("int")
    # some rows leave out the name or the player count
    roles.event_index(spark, sf).select(
        "id",
        F.when(key % 3 != 0, F.col("name")).alias("name"),
        "date",
        F.when(key % 4 != 0, F.col("players")).alias("players"),
    ).write.json(path)
    return standings.read_event_index(spark, path).withColumn("players", F.col("players").cast("long"))


@query(
    "rosters_roundtrip",
    """SELECT CAST(s.roster_id AS VARCHAR) AS roster_id, season, CAST(player AS VARCHAR) AS player, CAST(epoch(ts) AS BIGINT) AS ts, weight,
    m AS members FROM seasoned s JOIN (SELECT roster_id, string_agg(species || ':' || item || ':' || moves_text, ',' ORDER BY slot) AS m
    FROM member GROUP BY roster_id) q ON q.roster_id = s.roster_id""",
    "seasoned member",
)
def rosters_roundtrip(spark, sf):
    path = fresh_path(spark, "rosters")
    rows = roles.seasoned(spark, sf).join(roles.member_lists(spark, sf), "roster_id")
    tables.write_rosters(
        rows.select(
            F.col("roster_id").cast("string").alias("roster_id"),
            "season",
            F.col("player").cast("string").alias("player"),
            F.unix_timestamp("ts").alias("ts"),
            "weight",
            "members",
        ),
        path,
    )
    back = tables.read_rosters(spark, path)
    text = F.transform("members", lambda m: F.concat_ws(":", m["species"], m["item"], F.array_join(m["moves"], " ")))
    return back.where(F.col("won").isNull()).select(
        "roster_id", "season", "player", "ts", "weight", F.array_join(text, ",").alias("members")
    )


@query(
    "season_manifest",
    """SELECT season, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS first_ts, CAST(epoch(max(ts)) AS BIGINT) AS last_ts,
    round(avg(weight), 6) + 0.0 AS mean_weight FROM seasoned GROUP BY season""",
    "seasoned",
)
def season_manifest(spark, sf):
    out = tables.season_manifest(roles.seasoned(spark, sf))
    out = out.withColumns({c: F.unix_timestamp(c) for c in ("first_ts", "last_ts")})
    return rounded(out, "mean_weight")


@query(
    "merge_sources",
    """SELECT source, count(*) AS n, round(sum(w), 6) + 0.0 AS weight FROM (SELECT 'ladder' AS source, 1.0::DOUBLE AS w FROM roster
    WHERE source = 'ladder' AND won IS NOT NULL UNION ALL SELECT 'tournament', weight FROM roster WHERE source = 'tournament') q GROUP BY source""",
    "roster",
)
def merge_sources(spark, sf):
    rows = roles.roster(spark, sf).withColumn("ts", F.when((F.col("source") == "tournament") | F.col("won").isNotNull(), F.col("ts")))
    ladder = rows.where(F.col("source") == "ladder").drop("weight", "source")
    cup = rows.where(F.col("source") == "tournament").drop("source")
    merged = tables.merge_sources(ladder, cup)
    return rounded(merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")), "weight")


# --- parsers ---

MEMBER_COLUMNS = "roster_id, slot, species, item, ability, moves_text AS moves, nature, level, CASE WHEN ability = 'N' THEN 'F' ELSE '-' END AS gender"


def _flat(df, column):
    return df.select("roster_id", F.posexplode(column).alias("pos", "m")).select(
        "roster_id",
        (F.col("pos") + 1).cast("long").alias("slot"),
        "m.species",
        "m.item",
        "m.ability",
        F.array_join("m.moves", " ").alias("moves"),
        "m.nature",
        "m.level",
        F.coalesce("m.gender", F.lit("-")).alias("gender"),
    )


@query("parse_packed", f"SELECT {MEMBER_COLUMNS} FROM member", "member")
def parse_packed(spark, sf):
    text = roles.member_lists(spark, sf).select("roster_id", roles.packed_text().alias("packed"))
    return _flat(text, extract.parse_packed(F.col("packed")))


@query("parse_export", f"SELECT {MEMBER_COLUMNS} FROM member", "member")
def parse_export(spark, sf):
    text = roles.member_lists(spark, sf).select("roster_id", roles.export_text().alias("text"))
    return _flat(text, extract.parse_export(F.col("text")))


@query(
    "extract_rosters",
    BATTLE
    + """, m AS (SELECT roster_id, string_agg(species || ':' || moves_text, ',' ORDER BY slot) AS members FROM member GROUP BY roster_id)
    SELECT battle_id, side, player, ts, season, won, members FROM r JOIN m USING (roster_id)""",
    "member",
)
def extract_rosters(spark, sf):
    out = extract.rosters_of_logs(roles.battle_logs(spark, sf))
    text = F.transform("members", lambda m: F.concat_ws(":", m["species"], F.array_join(m["moves"], " ")))
    return out.withColumn("members", F.array_join(text, ","))


@query(
    "extract_pairings",
    BATTLE
    + """, f AS (SELECT r.*, n_members FROM r JOIN sized USING (roster_id) WHERE n_members = 6),
    g AS (SELECT battle_id AS pairing_id, count(*) AS n, battle_id || min(side) AS roster_a, battle_id || max(side) AS roster_b,
    arg_min(won, side) AS wa, arg_max(won, side) AS wb, count(won) AS k FROM f GROUP BY battle_id)
    SELECT pairing_id, roster_a, roster_b, CAST(wa AS INTEGER) AS label FROM g WHERE n = 2 AND k = 2 AND wa <> wb""",
    "member sized",
)
def extract_pairings(spark, sf):
    rosters = extract.rosters_of_logs(roles.battle_logs(spark, sf))
    return extract.extract_pairings(rosters.withColumn("roster_id", F.concat("battle_id", "side")))


@query(
    "extract_html_blocks",
    r"""WITH b AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1),
    lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), chr(10) || chr(10)) AS t, html FROM pages),
    c AS (SELECT page_id, CASE WHEN regexp_matches(html, '^\s*<') AND t <> '' THEN t ELSE html END AS t FROM b)
    SELECT page_id, md5(ENTITY_CHAIN) AS digest FROM c""".replace(
        "ENTITY_CHAIN",
        "regexp_replace(replace(replace(replace(replace(regexp_replace(t, '&quot;?', '\"', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')",
    ),
)
def extract_html_blocks(spark, sf):
    pages = roles.table(spark, sf, "pages")
    return pages.select("page_id", F.md5(html_blocks(F.col("html"), "p")).alias("digest"))


@query(
    "canonical_id",
    r"""SELECT p_partkey, lower(regexp_replace(p_brand || ' ' || p_name, '[^\p{L}\p{N}]', '', 'g')) AS id FROM part""",
)
def canonical(spark, sf):
    return roles.table(spark, sf, "part").select("p_partkey", canonical_id(F.concat_ws(" ", "p_brand", "p_name")).alias("id"))


@query(
    "parse_iso_ts",
    """SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) - CASE o_orderkey % 3 WHEN 1 THEN 7200 ELSE 0 END AS ts FROM orders""",
)
def parse_iso_ts(spark, sf):
    base = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    ending = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+02:00").otherwise("+00:00")
    text = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(base, ending).alias("t"))
    return text.select("k", epoch_of_iso(F.col("t")).alias("ts"))


@query(
    "placement_weight",
    """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 7 = 0 THEN NULL
    ELSE floor(o_totalprice / 10000)::INTEGER END AS r FROM orders)
    SELECT k, (round(8 * CASE WHEN r > 0 THEN 1 + 1.0 / r ELSE 1 END, 6) + 0.0)::DOUBLE AS weight FROM p""",
)
def placement_weight(spark, sf):
    rank = F.floor(F.col("o_totalprice") / 10000).cast("string")
    text = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderkey") % 7 == 0, "drop").otherwise(rank))
    rows = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.alias("placing"))
    return rounded(rows.select("k", extract.placement_weight(F.col("placing")).alias("weight")), "weight")


@query(
    "exclude_keywords",
    """SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    AND NOT contains(lower(c_name || ' ' || c_mktsegment), 'build') AND NOT contains(lower(c_name || ' ' || c_mktsegment), 'furn')""",
)
def exclude_keywords(spark, sf):
    return seasons.exclude_keywords(roles.event_index(spark, sf), ("Build", "FURN")).select("id")


SEASON_EVENTS = """WITH e AS (SELECT c_custkey, c_name || ' ' || c_mktsegment AS name, n AS players, d AS ts FROM customer JOIN (
    SELECT o_custkey, count(*) AS n, min(o_orderdate) AS d FROM orders GROUP BY 1) q ON o_custkey = c_custkey),
    k AS (SELECT *, CASE WHEN season IN ('y1995', 'y1997') THEN 'building' ELSE 'household' END AS own FROM season_w),
    s AS (SELECT e.*, k.season FROM e JOIN k ON e.ts BETWEEN k.start_ts AND k.end_ts WHERE NOT contains(lower(name), 'machinery')
    AND (own = 'building' OR NOT contains(lower(name), 'building')) AND (own = 'household' OR NOT contains(lower(name), 'household')))"""


def _season_events(spark, sf):
    windows = roles.seasons(spark)
    own = F.when(F.col("season").isin("y1995", "y1997"), "Building").otherwise("Household")
    tokens_ = windows.select("season", F.array(own).alias("tokens"))
    excluded = seasons.season_keywords(tokens_, off_format=("Machinery",))
    return seasons.season_windows(roles.event_index(spark, sf), windows.join(excluded, "season"), name="name")


@query("season_events", SEASON_EVENTS + " SELECT CAST(c_custkey AS VARCHAR) AS id, season FROM s", "season_w")
def season_events(spark, sf):
    return _season_events(spark, sf).select("id", "season")


@query(
    "largest_events",
    SEASON_EVENTS
    + """, r AS (SELECT CAST(c_custkey AS VARCHAR) AS id, season, players, row_number() OVER (PARTITION BY season ORDER BY players DESC,
    CAST(c_custkey AS VARCHAR)) AS r FROM s) SELECT id, season, players FROM r WHERE r <= 40""",
    "season_w",
)
def largest_events(spark, sf):
    out = seasons.largest_events(_season_events(spark, sf), 40)
    return out.select("id", "season", F.col("players").cast("long").alias("players"))


@query(
    "already_scraped",
    """SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def already_scraped(spark, sf):
    urgent = roles.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    stored = urgent.select(F.col("o_custkey").cast("string").alias("id")).distinct()
    return seasons.not_yet_stored(roles.event_index(spark, sf), stored).select("id")


# --- identity ---

HASHED = """WITH h AS (SELECT roster_id, substr(sha256('[' || string_agg(j, ',' ORDER BY j) || ']'), 1, 16) AS roster_hash,
    string_agg(species, ',' ORDER BY slot) AS species FROM (
    SELECT roster_id, slot, species, '{"ability":"' || ability || '","item":"' || item || '","moves":["' || array_to_string(list_sort(
    string_split(moves_text, ' ')), '","') || '"],"nature":"' || nature || '","species":"' || species || '"}' AS j FROM member) q GROUP BY roster_id)"""


def _identified(spark, sf):
    return roles.member_lists(spark, sf).withColumn("seq", F.col("roster_id"))


@query(
    "dedupe_rosters",
    HASHED
    + """ SELECT roster_hash, min(roster_id) AS roster_id, arg_min(species, roster_id) AS species, count(*) AS occurrence_count
    FROM h GROUP BY roster_hash""",
    "member",
)
def dedupe(spark, sf):
    out = dedupe_rosters(_identified(spark, sf))
    species = F.array_join(F.transform("members", lambda m: m["species"]), ",")
    return out.select("roster_hash", "roster_id", species.alias("species"), "occurrence_count")


@query(
    "duplicate_row_keys",
    HASHED
    + """ SELECT roster_id, roster_hash || '-' || row_number() OVER (PARTITION BY roster_hash ORDER BY roster_id) AS row_key FROM h""",
    "member",
)
def duplicate_keys(spark, sf):
    return duplicate_row_keys(_identified(spark, sf)).select("roster_id", "row_key")


@query(
    "inspection_fields",
    """SELECT roster_id, string_agg(species, ' | ' ORDER BY slot) AS species, string_agg(item, ' | ' ORDER BY slot) AS items,
    string_agg(ability, ' | ' ORDER BY slot) AS abilities, string_agg(nature, ' | ' ORDER BY slot) AS natures,
    string_agg(species || ': ' || replace(moves_text, ' ', ', '), ' | ' ORDER BY slot) AS moves FROM member GROUP BY roster_id""",
    "member",
)
def inspection(spark, sf):
    return inspection_fields(roles.member_lists(spark, sf))


# --- tokens ---

DIM = r"""dim AS (SELECT lower(regexp_replace(p_brand, '[^\p{L}\p{N}]', '', 'g')) AS id, min(p_type) AS t, min(p_size) AS hp FROM part GROUP BY 1)"""

TOKENS = (
    "WITH "
    + DIM
    + r""", mm AS (SELECT m.*, d.t, d.hp, string_split(moves_text, ' ') AS mv FROM member m JOIN dim d
    ON d.id = lower(regexp_replace(species, '[^\p{L}\p{N}]', '', 'g'))),
    tk AS (SELECT roster_id, slot, unnest(range(6 + len(mv) - 1)) AS pos, unnest(list_concat(
    ['type:' || lower(t), 'base_stat:hp:' || hp, 'item:' || lower(item), 'ability:' || lower(ability), 'nature:' || lower(nature)],
    list_transform(mv, lambda x: 'move:' || x))) AS token FROM mm)"""
)


def _tokens(spark, sf):
    return tokens.token_rows(roles.members(spark, sf), roles.dimension(spark, sf), roles.ROLE_STATS)


@query(
    "dimension_lookup",
    "WITH "
    + DIM
    + r""" SELECT roster_id, slot, CASE WHEN hp > 3 THEN t ELSE '' END AS type, CASE WHEN hp > 3 THEN hp ELSE 0 END AS hp FROM member LEFT JOIN dim
    ON dim.id = lower(regexp_replace(species, '[^\p{L}\p{N}]', '', 'g'))""",
    "member",
)
def dimension_lookup(spark, sf):
    # species whose stat is 3 or less are missing from the dimension and get the defaults
    known = roles.dimension(spark, sf).where(F.col("hp") > 3)
    out = tokens.dimension_lookup(roles.members(spark, sf), known, roles.ROLE_STATS)
    return out.select("roster_id", F.col("slot").cast("long").alias("slot"), F.array_join("types", ",").alias("type"), "hp")


@query(
    "attribute_tokens",
    TOKENS + " SELECT roster_id, slot, CAST(pos AS INTEGER) AS pos, token, split_part(token, ':', 1) NOT IN ('type', 'base_stat') AS maskable FROM tk",
    "member",
)
def attribute_tokens(spark, sf):
    out = _tokens(spark, sf).select("roster_id", "slot", "pos", "token", "maskable")
    return out.withColumn("slot", F.col("slot").cast("long"))


VOCAB = """, vb AS (SELECT token, CAST(row_number() OVER (ORDER BY f, token) + 4 AS INTEGER) AS id FROM (
    SELECT token, min((roster_id, slot, pos)) AS f FROM tk GROUP BY token) q UNION ALL SELECT * FROM (VALUES
    ('<PAD>', 0), ('<MASK>', 1), ('<UNK>', 2), ('<PKMN_CLS>', 3), ('<TEAM_CLS>', 4)) v(token, id))"""


@query("build_vocab", TOKENS + VOCAB + " SELECT token, id FROM vb", "member")
def build_vocab(spark, sf):
    return tokens.build_vocab(_tokens(spark, sf))


def _encoded(spark, sf):
    rows = stage(_tokens(spark, sf), "tokens")
    vocab, kinds = tokens.stored_vocab(rows)
    return tokens.encode_tokens(rows, vocab, kinds)


ENCODED = (
    TOKENS
    + VOCAB
    + """, en AS (SELECT roster_id, CAST((slot - 1) * (SELECT max(pos) + 1 FROM tk) + pos AS BIGINT) AS cell, coalesce(id, 2) AS value_id,
    CASE split_part(token, ':', 1) WHEN 'type' THEN 1 WHEN 'base_stat' THEN 2 WHEN 'item' THEN 3 WHEN 'ability' THEN 4 WHEN 'nature' THEN 5
    WHEN 'move' THEN 6 ELSE 0 END AS kind_id,
    split_part(token, ':', 1) NOT IN ('type', 'base_stat') AS maskable FROM tk LEFT JOIN vb USING (token))"""
)


@query(
    "encode_tokens",
    ENCODED
    + """ SELECT roster_id, count(*) AS n, CAST(sum(value_id * (cell + 1)) AS BIGINT) AS value_sum, CAST(sum(kind_id * (cell + 1)) AS BIGINT) AS kind_sum,
    string_agg(CASE WHEN maskable THEN cell END, ',' ORDER BY cell) AS maskable_at FROM en GROUP BY roster_id""",
    "member",
)
def encode_tokens(spark, sf):
    def weighted(name):
        scaled = F.transform(name, lambda v, i: v.cast("long") * (i + 1))
        return F.aggregate(scaled, F.lit(0).cast("long"), lambda t, x: t + x)

    return _encoded(spark, sf).select(
        "roster_id",
        F.size(F.filter("attr_mask", lambda m: m)).cast("long").alias("n"),
        weighted("value_ids").alias("value_sum"),
        weighted("kind_ids").alias("kind_sum"),
        F.array_join(F.transform("maskable_at", lambda i: i.cast("string")), ",").alias("maskable_at"),
    )


@query(
    "masked_examples",
    ENCODED
    + """ SELECT roster_id, CAST(cell AS INTEGER) AS target_at, CAST(value_id AS INTEGER) AS target_value_id, CAST(kind_id AS INTEGER) AS target_kind_id,
    CAST(value_sum - (value_id - 1) * (cell + 1) AS BIGINT) AS hidden_sum FROM (
    SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY md5(roster_id || '|' || cell || '|0'), cell) AS r FROM (SELECT *, sum(value_id * (cell + 1)) OVER (PARTITION BY roster_id) AS value_sum FROM en) e WHERE maskable) q WHERE r = 1""",
    "member",
)
def masked_examples(spark, sf):
    out = tokens.masked_examples(_encoded(spark, sf))
    hidden = F.aggregate(F.transform("value_ids", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda t, x: t + x)
    return out.select("roster_id", "target_at", "target_value_id", "target_kind_id", hidden.alias("hidden_sum"))


# --- what rosters hold ---


@query(
    "member_pool",
    r"""SELECT species_id, item_id, ability_id, move_ids, n, nature FROM (SELECT lower(regexp_replace(species, '[^\p{L}\p{N}]', '', 'g')) AS species_id,
    lower(item) AS item_id, lower(ability) AS ability_id, array_to_string(list_sort(string_split(moves_text, ' ')), ',') AS move_ids, count(*) AS n,
    arg_min(nature, (roster_id, slot)) AS nature FROM member GROUP BY 1, 2, 3, 4) q
    ORDER BY n DESC, species_id, item_id, ability_id, move_ids LIMIT 150""",
    "member",
)
def member_pool_query(spark, sf):
    out = member_pool(roles.members(spark, sf))
    return out.select("species_id", "item_id", "ability_id", F.array_join("move_ids", ",").alias("move_ids"), "n", "member.nature")


@query(
    "member_options",
    r"""WITH v AS (SELECT lower(regexp_replace(species, '[^\p{L}\p{N}]', '', 'g')) AS species_id, kind, value FROM (
    SELECT species, 'item' AS kind, item AS value FROM member UNION ALL SELECT species, 'ability', ability FROM member
    UNION ALL SELECT species, 'move', unnest(string_split(moves_text, ' ')) FROM member) q),
    c AS (SELECT species_id, kind, value, count(*) AS n FROM v GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY species_id, kind ORDER BY n DESC, value) AS r FROM c)
    SELECT species_id, kind, CAST(r AS INTEGER) AS rank, value, n FROM r WHERE r <= CASE kind WHEN 'item' THEN 6 WHEN 'ability' THEN 3 ELSE 12 END""",
    "member",
)
def member_options_query(spark, sf):
    return member_options(roles.members(spark, sf))


@query(
    "exclude_owned",
    r"""WITH m AS (SELECT roster_id, lower(regexp_replace(species, '[^\p{L}\p{N}]', '', 'g')) AS species_id, lower(item) AS item_id,
    lower(ability) AS ability_id, array_to_string(list_sort(string_split(lower(moves_text), ' ')), ',') AS move_ids FROM member),
    pool AS (SELECT DISTINCT species_id FROM (SELECT species_id, count(*) AS n FROM m GROUP BY species_id, item_id, ability_id, move_ids
      ORDER BY n DESC, species_id, item_id, ability_id, move_ids LIMIT 12) q),
    o AS (SELECT DISTINCT roster_id, species_id FROM m), c AS (SELECT roster_id, species_id FROM (SELECT DISTINCT roster_id FROM m) q, pool)
    SELECT roster_id, species_id FROM c ANTI JOIN o USING (roster_id, species_id)""",
    "member",
)
def exclude_owned_query(spark, sf):
    """Species of the twelve most frequent configurations, offered to every roster that lacks them."""
    held = stage(roles.members(spark, sf).drop("level"), "members")
    offered = stage(member_pool(held, 12).select("species_id").distinct(), "offered").agg(F.collect_set("species_id")).scalar()
    candidates = held.select("roster_id").distinct().select("roster_id", F.explode(offered).alias("species_id"))
    return exclude_owned(candidates, held.select("roster_id", "species"))
