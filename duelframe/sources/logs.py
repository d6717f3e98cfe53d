"""Contest logs to the fact tables by ordered windows instead of a per-log state machine.

One log is one row. Its lines become one line table; the state of the machine at each line
(phase, turn, users, what stands in each of the four places, health, last move) are running values
over the contest in line order, which plan to one exchange and few sorts. `state_table` holds all of it, and every
fact table is a filter and a projection of that table. A contest is bounded by one log.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.text import bare

PLACES = ("p1a", "p1b", "p2a", "p2b")
SIDES = ("p1", "p2")
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
# The kinds of lines that change the state or give a row.
TOKENS = (
    "start", "teampreview", "win", "tie", "turn", "t:", "player", "rated", "poke", "tier", "switch", "drag", "detailschange", "replace",
    "move", "-damage", "-heal", "faint", "-weather", "-status", "-ability", "-terastallize", "-fail",
)
# Knock-out classes, first substring of the move text that is met, in this order.
KO_TYPES = (
    ("brn", "BURN"), ("psn", "POISON"), ("tox", "POISON"), ("sandstorm", "WEATHER"), ("hail", "WEATHER"), ("snow", "WEATHER"),
    ("recoil", "MOVE"), ("spikes", "HAZARD"), ("stealth rock", "HAZARD"), ("sticky web", "HAZARD"),
)
#: Columns of a log that fill what the log does not say: column, field of battle, whether it is a whole number.
META = (("uploadtime", "upload_time", True), ("rating", "rating", True), ("formatid", "format_id", False), ("format", "format", False))


def _name(raw: Column) -> Column:
    """Nickname after the place, without a gender or shiny tail."""
    after = F.when(raw.contains(": "), F.substring(raw, F.instr(raw, ": ") + 2, F.length(raw))).otherwise(raw)
    return bare(F.when(after.contains(","), F.regexp_replace(after, r"(?i),\s*(M|F|shiny|shiny M|shiny F)$", "")).otherwise(after))


def _species(details: Column) -> Column:
    return bare(F.substring_index(details, ",", 1))


def _place(raw: Column) -> Column:
    return bare(F.substring_index(raw, ":", 1))


def hp_share(text: Column) -> Column:
    """Health in percent: a/b, a bare number, or 0 for fainted; else null."""
    t = bare(text)
    a, b = (F.regexp_extract(t, r"^(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)", i).try_cast("double") for i in (1, 2))
    whole = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.when(t.isin("0 fnt", "fnt", "0"), 0.0).when(b == 0, 0.0).when(b.isNotNull(), F.bround(a / b * 100, 2)).otherwise(whole)


def ko_type(move: Column) -> Column:
    """Class of a knock-out by its move text; MOVE where nothing is met or there is no text."""
    text = F.lower(F.coalesce(move, F.lit("")))
    out = F.when(F.lit(False), "MOVE")
    for part, name in KO_TYPES:
        out = out.when(text.contains(part), name)
    return out.otherwise("MOVE")


def contest_id(log: Column, stem: Column | None = None) -> Column:
    """The file stem if it is a replay id, else a digest of the head of the log."""
    digest = F.concat(F.lit("battle-"), F.left(F.md5(F.left(log, F.lit(500))), F.lit(12)))
    return digest if stem is None else F.when(stem.rlike(r"^[\w\-]+-\d+"), stem).otherwise(digest)


def valid_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First log of each id, and (source_file, battle_id, error) of blank logs (L22, K5, P13, U6); null logs are dropped silently.

    First is the log of the smallest (source_file, row_no), where the table has these columns, then of the smallest text.
    """
    rows = logs.where("log IS NOT NULL")
    blank = F.regexp_replace("log", r"(?U)\s+", "") == ""
    order = [F.col(c) for c in ("source_file", "row_no") if c in logs.columns]
    first = Window.partitionBy("battle_id").orderBy(*order, F.md5("log"))
    good = rows.where(~blank).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    source = F.col("source_file") if "source_file" in logs.columns else F.lit(None).cast("string")
    return good, rows.where(blank).select(source.alias("source_file"), "battle_id", F.lit("Empty or non-string log").alias("error"))


def line_table(logs: DataFrame) -> DataFrame:
    """(battle_id, seq, token, a): the lines that matter, a holds the fields (L1)."""
    lines = logs.select("battle_id", F.posexplode(F.split("log", LINE_BREAK)).alias("seq", "raw")).select("battle_id", "seq", bare(F.col("raw")).alias("line"))
    lines = lines.where(F.col("line").startswith("|")).select("battle_id", "seq", F.split("line", "\\|").alias("a"))
    return lines.withColumn("token", F.get("a", F.lit(1))).where(F.col("token").isin(*TOKENS))


def _tag(name: str, start: int) -> Column:
    """Text after the last field from `start` on that begins with a tag such as [of]; null without one."""
    fields = F.filter(F.transform(F.slice("a", start, F.greatest(F.size("a"), F.lit(1))), bare), lambda x: x.startswith(name))
    return bare(F.replace(F.try_element_at(fields, F.lit(-1)), F.lit(name), F.lit("")))


def state_table(logs: DataFrame) -> DataFrame:
    """The lines with the state of the machine before them.

    phase; turn (of this line); p1_user, p2_user; for each place its name, species, health, last move, and where it was first
    entered and first moved; and of the line itself: place, side, username, nick, species, hp_new, hp_before, entry, lead,
    and whether the log is broken (a roster line of an unknown side).
    """
    order = Window.partitionBy("battle_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tok, arg, size = F.col("token"), lambda i: F.get("a", F.lit(i)), F.size("a")
    step = F.when(tok.isin("start", "turn"), "battle").when(tok == "teampreview", "preview").when(tok.isin("win", "tie"), "post")
    rows = line_table(logs).withColumns({
        "phase": F.coalesce(F.last(step, True).over(before), F.lit("header")),
        "turn": F.coalesce(F.last(F.when(tok == "turn", bare(arg(2)).try_cast("int")), True).over(upto), F.lit(0)),
    })
    live, head = F.col("phase") == "battle", F.col("phase").isin("header", "preview")
    entry = (size >= 4) & ((tok.isin("switch", "drag") & live) | ((tok == "switch") & (F.col("phase") == "preview")))
    change = live & tok.isin("detailschange", "replace") & (size >= 4)
    rows = rows.withColumns({"live": live, "head": head, "entry": entry, "place": F.when(entry | live, _place(arg(2))), "nick": _name(arg(2))})
    rows = rows.withColumns({
        "side": F.left("place", F.lit(2)),
        "hp_new": F.when(F.col("entry"), hp_share(arg(4))).when(live & tok.isin("-damage", "-heal") & (size >= 4), hp_share(arg(3))),
        "sp_new": F.when(F.col("entry") | change, _species(arg(3))),
        "mv_new": F.when(live & (tok == "move") & (size >= 5), arg(3)),
        "user": F.when(head & (tok == "player") & (size >= 4), F.nullif(bare(arg(3)), F.lit(""))),
    })
    # the last species of a nickname of the side, before the rows grow wide
    own = Window.partitionBy("battle_id", "side", "nick").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"known_as": F.last("sp_new", True).over(own), "opening": F.col("entry") & ((F.col("phase") == "preview") | (F.col("turn") == 0))})
    bad = head & (tok == "poke") & (size >= 4) & ~arg(2).isin(*SIDES)
    state = {"broken": F.coalesce(F.max(bad).over(every), F.lit(False))}
    for s in SIDES:
        state[f"{s}_user"] = F.first(F.when(arg(2) == s, F.col("user")), True).over(upto)
    for p in PLACES:
        here = F.col("place") == p
        state[f"{p}_name"] = F.last(F.when(here & F.col("entry"), F.col("nick")), True).over(before)
        state[f"{p}_species"] = F.last(F.when(here, F.col("sp_new")), True).over(before)
        state[f"{p}_hp"] = F.last(F.when(here, F.col("hp_new")), True).over(before)
        state[f"{p}_move"] = F.last(F.when(here, F.col("mv_new")), True).over(before)
        state[f"{p}_moved"] = F.min(F.when(here & F.col("mv_new").isNotNull(), F.col("seq"))).over(before)
        state[f"{p}_opened"] = F.max(F.when(here & F.col("opening"), F.lit(True))).over(before)
        state[f"{p}_entered"] = F.min(F.when(here & F.col("entry"), F.col("seq"))).over(before)
    return rows.withColumns(state).withColumns({
        "species": F.coalesce(species_of(F.col("place"), F.col("nick")), F.col("known_as"), F.lit("")),
        "hp_before": F.coalesce(at(F.col("place"), "hp"), F.lit(100.0)),
        "username": F.coalesce(F.when(F.col("side") == "p1", F.col("p1_user")).when(F.col("side") == "p2", F.col("p2_user")), F.lit("")),
        "lead": F.col("opening") & at(F.col("place"), "opened").isNull(),
    }).drop("known_as", "opening", *[f"{p}_opened" for p in PLACES])


def at(place: Column, what: str) -> Column:
    """What the state says of a place."""
    return F.coalesce(*[F.when(place == p, F.col(f"{p}_{what}")) for p in PLACES])


def species_of(place: Column, nick: Column) -> Column:
    """Species of a nickname that stands at its place now, else null."""
    return F.when(at(place, "name") == nick, at(place, "species"))


def _damages(state: DataFrame) -> DataFrame:
    """Damage lines with attacker, its species and the move, and what is known of the defender.

    The attacker is named by [of]; else it is what stands now at the opposing place that moved first in
    the log. The move is the last one of the attacker's place, else the [from] text.
    """
    tok = F.col("token")
    rows = state.where(F.col("live") & (tok == "-damage") & F.col("hp_new").isNotNull())
    rows = rows.withColumns({"of": _tag("[of]", 5), "cause": F.coalesce(_tag("[from]", 5), F.lit(""))})
    rows = rows.withColumns({"of_place": _place(F.col("of")), "of_nick": F.nullif(_name(F.col("of")), F.lit(""))})
    about = lambda p, *first: F.struct(*first, F.col(f"{p}_name").alias("name"), F.col(f"{p}_species").alias("sp"), F.col(f"{p}_move").alias("move"))
    rival = lambda p: (F.col("side") != p[:2]) if p[:2] == "p1" else (F.col("side") == "p1")
    foes = F.array(*[F.when(rival(p) & F.col(f"{p}_moved").isNotNull(), about(p, F.col(f"{p}_moved").alias("o"))) for p in PLACES])
    named = F.array(*[F.when(F.col(f"{p}_name") == F.col("of_nick"), about(p, F.col(f"{p}_entered").alias("o"))) for p in PLACES])
    rows = rows.withColumn("foe", F.get(F.array_sort(F.array_compact(foes)), F.lit(0))).withColumn("by", F.get(F.array_sort(F.array_compact(named)), F.lit(0)))
    rows = rows.withColumn("of_species", species_of(F.col("of_place"), F.col("of_nick")))
    # a named attacker that has left its place is known by the last species of its nickname
    asked = rows.where("of_nick IS NOT NULL AND of_species IS NULL").select("battle_id", "seq", F.left("of_place", F.lit(2)).alias("side"), F.col("of_nick").alias("nick"))
    seen = state.where(tok.isin("switch", "drag", "detailschange", "replace") & F.col("sp_new").isNotNull()).select("battle_id", "side", "nick", F.col("seq").alias("at_seq"), "sp_new")
    left = asked.join(seen, ["battle_id", "side", "nick"]).where("at_seq < seq").groupBy("battle_id", "seq").agg(F.max_by("sp_new", "at_seq").alias("left_species"))
    rows = rows.join(left, ["battle_id", "seq"], "left")
    told = F.col("of_nick").isNotNull()
    full = lambda c: F.nullif(c, F.lit(""))
    return rows.withColumns({
        "attacker": F.coalesce("of_nick", "foe.name", F.lit("")),
        "attacker_species": F.when(told, F.coalesce("of_species", "left_species", F.lit(""))).otherwise(F.coalesce("foe.sp", F.lit(""))),
        "move_name": F.coalesce(full(F.when(told, F.col("by.move")).otherwise(F.col("foe.move"))), F.col("cause")),
    })


def _knock_outs(state: DataFrame, damages: DataFrame) -> DataFrame:
    """Faints that follow a lethal damage of their place with no faint between."""
    tok = F.col("token")
    hit = F.struct("attacker", "attacker_species", "species", "move_name")
    lethal = damages.where("hp_new = 0").select("battle_id", "place", "seq", "turn", "nick", hit.alias("hit"))
    falls = state.where(F.col("live") & (tok == "faint") & (F.size("a") >= 3))
    falls = falls.select("battle_id", "place", "seq", "turn", "nick", F.lit(None).cast(lethal.schema["hit"].dataType).alias("hit"))
    order = Window.partitionBy("battle_id", "place").orderBy("seq")
    # a later lethal damage replaces an earlier one, and a faint takes it away: the line before a faint decides
    chain = lethal.unionByName(falls).withColumn("last", F.lag("hit").over(order)).where("hit IS NULL AND last IS NOT NULL")
    return chain.select(
        "battle_id", _turn_no(), F.col("last.attacker").alias("killer_pokemon"), F.col("nick").alias("victim_pokemon"),
        F.col("last.attacker_species").alias("killer_species"), F.col("last.species").alias("victim_species"),
        F.col("last.move_name").alias("move_name"), ko_type(F.col("last.move_name")).alias("ko_type"),
    )


def _moves(state: DataFrame) -> DataFrame:
    """Moves with their success: a tag of the line, or a later -fail of the same nickname before the next move of the log, undoes it."""
    tok, arg = F.col("token"), lambda i: F.get("a", F.lit(i))
    is_move = (tok == "move") & (F.size("a") >= 5)
    rows = state.where(F.col("live") & (is_move | ((tok == "-fail") & (F.size("a") >= 3))))
    rows = rows.withColumn("_m", F.count_if(is_move).over(Window.partitionBy("battle_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("battle_id", "_m")
    mover = F.max(F.when(is_move, F.col("nick"))).over(group)
    rows = rows.withColumn("_mover", mover).withColumn("_undone", F.coalesce(F.bool_or((tok == "-fail") & (F.col("nick") == F.col("_mover"))).over(group), F.lit(False)))
    missed = F.exists(F.slice("a", 6, F.greatest(F.size("a"), F.lit(1))), lambda x: bare(x).isin("[miss]", "[notarget]"))
    return rows.where(is_move).select(
        "battle_id", _turn_no(), "username", F.col("nick").alias("pokemon_name"), "species", arg(3).alias("move_name"),
        F.coalesce(_name(arg(4)), F.lit("")).alias("target_name"), F.when(missed | F.col("_undone"), 0).otherwise(1).cast("tinyint").alias("success"),
    )


def _slots(state: DataFrame) -> DataFrame:
    """Roster lines with what was seen of them (L6, L21): matched by species with all that entered and with the leads of the side."""
    tok, arg = F.col("token"), lambda i: F.get("a", F.lit(i))
    # a lead belongs to the last side that its user took
    lead_side = F.when(F.col("username") == "", None).when(F.col("username") == F.col("p2_user"), "p2").otherwise(F.col("side"))
    entries = state.where(tok.isin("switch", "drag") & F.col("entry")).select("battle_id", "side", "sp_new", F.when(F.col("lead") & (F.col("sp_new") != ""), lead_side).alias("lead_side"))
    sent = entries.groupBy("battle_id", F.col("side").alias("player_side")).agg(F.collect_set("sp_new").alias("sent"))
    led = entries.where("lead_side IS NOT NULL").groupBy("battle_id", F.col("lead_side").alias("player_side")).agg(F.collect_set("sp_new").alias("led"))
    poke = state.where(F.col("head") & (tok == "poke") & (F.size("a") >= 4)).select("battle_id", "seq", arg(2).alias("player_side"), _species(arg(3)).alias("pokemon_name"))
    numbered = poke.withColumn("slot_no", F.row_number().over(Window.partitionBy("battle_id", "player_side").orderBy("seq")).cast("smallint"))
    rows = numbered.join(sent, ["battle_id", "player_side"], "left").join(led, ["battle_id", "player_side"], "left")
    masked, name = F.col("pokemon_name").endswith("-*"), F.lower("pokemon_name")
    base = F.regexp_replace(name, r"-\*$", "")
    fits = lambda s: F.when(masked, (F.lower(s) == base) | F.startswith(F.lower(s), F.concat(base, F.lit("-")))).otherwise(F.lower(s) == name)
    hits = lambda c: F.array_sort(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), fits))
    rows = rows.withColumns({"seen": hits("sent"), "opened": hits("led")})
    one, many = F.size("seen") == 1, F.size("seen") > 1
    return rows.select(
        "battle_id", "player_side", "slot_no", "pokemon_name", (F.size("opened") > 0).cast("tinyint").alias("is_lead"),
        F.when(~masked, F.col("pokemon_name")).when(one, F.get("seen", F.lit(0))).otherwise("").alias("species_observed"),
        F.when(~masked, "listed").when(one, "observed").when(many, "ambiguous").otherwise("unobserved").alias("form_status"),
        (F.size("seen") > 0).cast("tinyint").alias("was_sent_out"),
    )


def _battles(state: DataFrame, logs: DataFrame) -> DataFrame:
    """One row per log: what its lines say, and where they say nothing, what the columns of the log say."""
    tok, arg = F.col("token"), lambda i: F.get("a", F.lit(i))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("seq")))
    in_head = lambda token, value: F.when(F.col("head") & (tok == token) & (F.size("a") > 2), value)
    tier = F.array_join(F.slice("a", 3, F.size("a")), "|")
    rated = bare(arg(2))
    said = state.where(tok.isin("tier", "t:", "rated", "win", "turn", "start", "poke")).groupBy("battle_id").agg(
        last(in_head("tier", tier)).alias("format"), last(in_head("t:", rated.try_cast("long"))).alias("upload_time"),
        F.nullif(last(in_head("rated", F.when(rated.rlike(r"^-*\d+$"), rated.try_cast("int")))), F.lit(0)).alias("rating"),
        last(F.when((tok == "win") & (F.size("a") > 2), bare(arg(2)))).alias("winner_name"),
        last(F.when(tok == "turn", rated.try_cast("int"))).alias("turn_count"), F.max("broken").alias("broken"),
    )
    held = logs.select(
        "battle_id", (F.col("replay_path") if "replay_path" in logs.columns else F.lit(None)).cast("string").alias("replay_path"),
        *[(F.bround(F.col(c), 0).try_cast("long") if number else F.col(c).cast("string")).alias(f"meta_{to}") for c, to, number in META if c in logs.columns],
    )
    rows = held.join(said, "battle_id", "left").where(~F.coalesce("broken", F.lit(False)))
    rows = rows.withColumn("format_id", F.lower(F.regexp_replace("format", r"(?U)[\[\]\s]+", "")))
    for c, to, number in META:
        if c in logs.columns:
            rows = rows.withColumn(to, F.coalesce(F.col(to) if number else F.nullif(F.col(to), F.lit("")), F.col(f"meta_{to}")))
    return rows.select(
        "battle_id", F.coalesce("format", F.lit("")).alias("format"), F.coalesce("format_id", F.lit("")).alias("format_id"), F.col("upload_time").cast("long").alias("upload_time"),
        F.col("rating").cast("int").alias("rating"), "winner_name", "replay_path", F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
    )


def _players(state: DataFrame) -> DataFrame:
    """One row per side (L4, L20): the first line names the user, a later one only fills the rating; a winner's name decides all sides."""
    tok, arg = F.col("token"), lambda i: F.get("a", F.lit(i))
    rating = F.when(bare(arg(5)).rlike(r"^-*\d+$"), bare(arg(5)).try_cast("int"))
    won = F.max_by(bare(arg(2)), F.when((tok == "win") & (F.size("a") > 2), F.col("seq"))).over(Window.partitionBy("battle_id"))
    rows = state.where(((tok == "player") & F.col("user").isNotNull()) | (tok == "win")).withColumn("won", won).where("user IS NOT NULL")
    sides = rows.groupBy("battle_id", arg(2).alias("side")).agg(
        F.min_by("user", "seq").alias("username"), F.min_by(rating, F.when(rating.isNotNull(), F.col("seq"))).alias("rating_before"), F.max("won").alias("won")
    )
    result = F.when(F.col("won").isNotNull(), F.when(F.col("username") == F.col("won"), "WIN").otherwise("LOSS"))
    return sides.select("battle_id", "username", "side", "rating_before", F.lit(None).cast("int").alias("rating_after"), result.alias("result"))


class FactTables(Mapping):
    """The fact tables of first logs by name, each built when it is asked for, and `errors`.

    Unknown owners and species are '' as in the logs; times, ratings and results are null where absent.
    A log with a roster line of an unknown side is an error and gives no facts.
    """

    def __init__(self, logs: DataFrame, whole: DataFrame, save=None):
        self.logs, self.whole, self.state, self.save = logs, whole, whole.where("NOT broken"), save
        self._builders = {
            "battle": lambda: _battles(self.whole, self.logs), "players": lambda: _players(self.state).select("username").distinct(),
            "battle_players": lambda: _players(self.state), "battle_team_slot": lambda: _slots(self.state), "battle_leads": lambda: _leads(self.state),
            "battle_move": lambda: _moves(self.state), "battle_damage": lambda: _damage_rows(self.damages), "battle_ko": lambda: _knock_outs(self.state, self.damages),
            "battle_faint": lambda: self._event("faint", 3), "battle_switch": lambda: _switches(self.state), "battle_weather": lambda: _weather(self.state),
            "battle_status": lambda: self._event("-status", 4, "status_code"), "battle_ability": lambda: self._event("-ability", 4, "ability_name"),
            "battle_tera": lambda: self._event("-terastallize", 4, "tera_type"), "battle_field_state": lambda: _field_states(self.state),
            "errors": lambda: _broken(self.whole),
        }

    @functools.cached_property
    def damages(self) -> DataFrame:
        """The damage lines with attacker and move, of which two tables are made."""
        found = _damages(self.state)
        return self.save(found) if self.save else found

    def __getitem__(self, name: str) -> DataFrame:
        return self._builders[name]()

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def _event(self, token: str, fields: int, value: str | None = None) -> DataFrame:
        rows = self.state.where(F.col("live") & (F.col("token") == token) & (F.size("a") >= fields))
        extra = [bare(F.get("a", F.lit(3))).alias(value)] if value else []
        return rows.select("battle_id", _turn_no(), "username", F.col("nick").alias("pokemon_name"), "species", *extra)


def _turn_no() -> Column:
    return F.col("turn").cast("smallint").alias("turn_no")


def _leads(state: DataFrame) -> DataFrame:
    rows = state.where(F.col("token").isin("switch", "drag") & F.col("lead")).select("battle_id", "seq", "username", F.col("nick").alias("pokemon_name"), F.col("sp_new").alias("species"), (F.ascii(F.right("place", F.lit(1))) - 96).cast("tinyint").alias("lead_slot"))
    first = rows.groupBy("battle_id", "username", "pokemon_name", "lead_slot").agg(F.min_by("species", "seq").alias("species"))
    return first.select("battle_id", "username", "pokemon_name", "species", "lead_slot")


def _damage_rows(damages: DataFrame) -> DataFrame:
    share = F.bround(F.col("hp_before") - F.col("hp_new"), 2)
    return damages.select(
        "battle_id", _turn_no(), F.col("attacker").alias("attacker_pokemon"), F.col("nick").alias("defender_pokemon"), "attacker_species", F.col("species").alias("defender_species"),
        "move_name", F.col("hp_before").cast("float").alias("hp_before"), F.col("hp_new").cast("float").alias("hp_after"), share.cast("float").alias("damage_pct"),
    )


def _switches(state: DataFrame) -> DataFrame:
    return state.where("token IN ('switch', 'drag') AND entry AND NOT lead").select("battle_id", _turn_no(), "username", F.col("nick").alias("pokemon_name"), F.col("sp_new").alias("species"))


def _weather(state: DataFrame) -> DataFrame:
    arg = F.get("a", F.lit(2))
    upkeep = F.exists(F.slice("a", 4, F.size("a")), lambda x: x.contains("[upkeep]"))
    rows = state.where(F.col("live") & (F.col("token") == "-weather") & (F.size("a") >= 3) & ~arg.isin("none", "None") & ~upkeep)
    return rows.select("battle_id", _turn_no(), arg.alias("weather_name"), F.coalesce(_name(_tag("[of]", 4)), F.lit("")).alias("source_pokemon"))


def _field_states(state: DataFrame) -> DataFrame:
    names = zip(PLACES, ("p1_left", "p1_right", "p2_left", "p2_right"), strict=True)
    return state.where("token = 'turn'").select("battle_id", _turn_no(), *[F.coalesce(F.col(f"{p}_name"), F.lit("")).alias(n) for p, n in names])


def _broken(whole: DataFrame) -> DataFrame:
    return whole.where("broken").select(F.lit(None).cast("string").alias("source_file"), "battle_id", F.lit("roster line of an unknown side").alias("error")).distinct()


def fact_tables(logs: DataFrame, save=None) -> FactTables:
    """The fact tables of first logs (battle_id, log and, where they are, replay_path and META).

    save: writes a table, partitioned by given columns, and gives it back, such as Scratch.save, so that the state is computed once for
    all tables and each reads the lines of its kinds only; without it every table is a lazy projection of the state.
    """
    whole = state_table(logs)
    return FactTables(logs, whole if save is None else save(whole, "token"), save)
