"""Cash messages: authorisation, kind, entry parsing, undo (T2-T6, batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import bind, iso_date
from ledgerloom.functions.text import text_or_empty
from ledgerloom.schema import AMOUNT

# First words that mark money in (fixed values).
CREDIT_WORDS = ["atm", "received", "deposit", "credit", "cashin", "refund"]
# The patterns of an entry's parts (fixed values).
AMOUNT_TOKEN = r"([+-]?)(\d[\d,]*(?:\.\d+)?)"
ISO_TOKEN = r"\b(\d{4}-\d{2}-\d{2})\b"
ENTRY_PREFIX = r"(?i)^/(?:cash|add)\b"
DEFAULT_DESCRIPTION = "Cash"

# Messages of one chat are worked on in runs of this many update ids.
SLICE = 100_000


def authorised(messages: DataFrame, chat_id: int | None, users: dict[int, str]) -> DataFrame:
    """Messages of the configured chat from allowed users, with the user's label.

    Without a configured chat nothing passes. The user map is configuration and compiles
    into the filter.
    """
    if not chat_id or not users:
        return messages.filter(F.lit(False)).withColumn("label", F.lit(None).cast("string"))
    pairs = [x for uid, name in users.items() for x in (F.lit(int(uid)).cast("long"), F.lit(name))]
    label = F.element_at(F.create_map(*pairs), F.col("user_id").cast("long"))
    return (
        messages.filter(F.col("chat_id") == chat_id)
        .withColumn("label", label)
        .filter(F.col("label").isNotNull())
    )


def message_kind(messages: DataFrame, commands_as_entries: bool = True) -> DataFrame:
    """``undo``, ``help``, ``ignored`` or ``entry``.

    ``/cash ...`` and ``/add ...`` are entries unless ``commands_as_entries`` is off.
    """
    text = F.trim(text_or_empty("text"))
    command = F.split(F.lower(text), "@")[0]
    entry_command = text.rlike(ENTRY_PREFIX) if commands_as_entries else F.lit(False)
    return messages.withColumn(
        "kind",
        F.when(command == "/undo", "undo")
        .when(command.isin("/start", "/help"), "help")
        .when(entry_command, "entry")
        .when(text.startswith("/"), "ignored")
        .otherwise("entry"),
    )


def parse_cash_entry(messages: DataFrame) -> DataFrame:
    """T4: date, description, amount and direction; ``amount`` is NULL for chatter.

    "Today" is the day the message was sent, so a replay gives the same rows.
    """
    today = F.col("sent_at").cast("date")
    body = F.trim(F.regexp_replace(F.trim(text_or_empty("text")), ENTRY_PREFIX, ""))

    def dated(text: Column) -> Column:
        iso = F.regexp_extract(text, ISO_TOKEN, 1)
        iso_value = F.when(iso != "", iso_date(iso))
        yesterday = (iso == "") & text.rlike(r"(?i)\byesterday\b")
        dateless = (
            F.when(iso_value.isNotNull(), F.replace(text, iso, F.lit(" ")))
            .when(iso != "", text)
            .when(yesterday, F.regexp_replace(text, r"(?i)\byesterday\b", " "))
            .otherwise(F.regexp_replace(text, r"(?i)\btoday\b", " "))
        )
        return F.struct(
            F.coalesce(iso_value, F.when(yesterday, F.date_sub(today, 1)), today).alias("day"),
            F.lower(F.regexp_extract(text, r"^(\S+)", 1)).alias("first"),
            dateless.alias("rest"),
        )

    def priced(text: Column) -> Column:
        token = F.regexp_extract(text, AMOUNT_TOKEN, 0)
        digits = F.regexp_replace(F.regexp_extract(text, AMOUNT_TOKEN, 2), ",", "")
        at = F.instr(text, token)
        rest = F.concat(F.substr(text, F.lit(1), at - 1), F.lit(" "), F.substr(text, at + F.length(token)))
        return F.struct(
            F.when(token != "", digits).try_cast(AMOUNT).alias("size"),
            F.regexp_extract(text, AMOUNT_TOKEN, 1).alias("sign"),
            F.trim(F.btrim(F.trim(F.regexp_replace(rest, r"\s+", " ")), F.lit(" -"))).alias("described"),
        )

    # Each text is read in one place; spelled out, the generated code would pass its limit.
    entry = bind(body, lambda b: bind(dated(b), lambda d: F.struct(d.alias("d"), priced(d["rest"]).alias("p"))))
    d, p = F.col("_entry")["d"], F.col("_entry")["p"]
    described = F.when(p["described"] == "", DEFAULT_DESCRIPTION).otherwise(p["described"])
    return (
        messages.withColumn("_entry", entry)
        .withColumn("txn_date", d["day"])
        .withColumn("amount", F.when(p["size"] > 0, p["size"]))
        .withColumn("is_credit", (p["sign"] == "+") | d["first"].isin(CREDIT_WORDS))
        .withColumn("description", F.when(p["size"] > 0, described))
        .drop("_entry")
    )


def cash_events(messages: DataFrame) -> DataFrame:
    """The events that matter to undo: parsed entries and undo commands."""
    return parse_cash_entry(message_kind(messages)).filter(
        (F.col("kind") == "undo") | ((F.col("kind") == "entry") & F.col("amount").isNotNull())
    )


def _slice(update_id: Column | str) -> Column:
    col = F.col(update_id) if isinstance(update_id, str) else update_id
    return F.floor(col / SLICE)


def apply_undo(events: DataFrame) -> DataFrame:
    """Entries that stay. An entry goes iff the chat's next event is an undo.

    One chat may hold any share of all messages, so its events are cut into runs of
    update ids: the next event is looked up inside the run, and for the last event of a
    run among the runs' first events (one row per run).
    """
    sliced = events.withColumn("_slice", _slice("update_id"))
    inside = Window.partitionBy("chat_id", "_slice").orderBy("update_id")
    firsts = sliced.groupBy("chat_id", "_slice").agg(F.min_by("kind", "update_id").alias("_first_kind"))
    across = Window.partitionBy("chat_id").orderBy("_slice")
    followers = firsts.select("chat_id", "_slice", F.lead("_first_kind").over(across).alias("_next_slice_kind"))
    return (
        sliced.withColumn("_next", F.lead("kind").over(inside))
        .join(followers, ["chat_id", "_slice"])
        .withColumn("_next", F.coalesce("_next", "_next_slice_kind"))
        .filter((F.col("kind") == "entry") & (F.coalesce(F.col("_next"), F.lit("")) != "undo"))
        .drop("_next", "_next_slice_kind", "_slice")
    )


def cash_transactions(entries: DataFrame) -> DataFrame:
    """Parsed entries as transactions of the literal account ``cash``."""
    signed = F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount"))
    return entries.select(
        "update_id",
        "txn_date",
        "description",
        signed.cast(AMOUNT).alias("amount"),
        F.lit("cash").alias("account"),
        F.lit("").alias("remarks"),
        *[c for c in ("label", "chat_id") if c in entries.columns],
    )
