"""Registry, driver tables, and the support-flavoured views derived from them.

The driver tables hold generated prose, so rule operators would rarely fire on them. The
views put one phrase of a fixed list, picked by row id, in front of every whole text;
sizes and keys stay those of the tables. ``*_SQL`` strings are the same views for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.session import configure, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if it has one, its DuckDB twin."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows carry heavy work per text: spread if it is a single split."""
    return spread(table(spark, sf_dir, name))


CUSTOMER_PHRASES = (
    "@AppleSupport my battery will drain to 10% by noon, see https://t.co/abc123",
    "The charger cable is hot and the battery health percentage drops from 90",
    "I forgot my Apple ID password and I am locked out of iCloud",
    "Cannot sign in, the two-factor verification code never comes @AppleSupport",
    "Why was I charged twice for the same subscription? I want a refund",
    "There is an unauthorized payment on my bank invoice from iTunes",
    "My phone is frozen on a black screen and a hard reset does nothing",
    "It keeps going through a boot loop and will crash on restart",
    "The iOS 11 software update failed half way on my iPhone",
    "error occurred installing the iOS update 11.2 on my iPad",
    "What are the store hours, and do I need an appointment at the genius bar?",
    "Is there a case in another color for my MacBook with shipping?",
    "The adapter started smoking and burned the desk!",
    "My screen shattered and I cut my thumb, I was shocked",
    "I will call my lawyer and the police about this",
    "Somebody hacked me and there was a SIM swap",
    "This is the 3rd time I write, useless support",
    "I was worried it would melt but it is fine, thankfully no smoke",
    "There was no fire, it is just warm",
    "The new camera feature is fire, honestly",
    "My battery is dying fast since yesterday",
    "there is a fire in my kitchen near the outlet",
    "This phone is the bomb, i love it",
    "a bomb of a bill on my credit card",
    "hello there, anyone listening?",
    "ok",
    "@AppleSupport https://t.co/only",
    "Why   does\tmy watch say 10.3 and not 12.1?",
    "Thanks for nothing @AppleSupport @115858",
)

REPLY_PHRASES = (
    "@customer_1 We'd like to help. DM us your iOS version here: https://t.co/dm1",
    "@customer_2 Which device model are you using? Send us a DM https://t.co/dm2",
    "@customer_3 Check out this article for help: https://apple.co/help1",
    "@customer_4 @115858 We are truly sorry. We will replace it free of charge.",
    "@customer_5 We can refund you, visit https://reportaproblem.apple.com",
    "@customer_6 We are sorry to hear you are having trouble. Please DM us your device details",
    "@customer_7 Reset it at https://iforgot.apple.com and let us know",
    "@customer_8 We can guarantee a fix. It is definitely a hardware fault.",
    "Thanks for reaching out to us.",
    "@customer_9 Happy to help! Have you tried to update to iOS 11.1?",
    "@customer_10 We guarantee this works, free repair included",
    "@customer_11 send a direct message to our team https://twitter.com/messages/compose",
    "@customer_12 We offer some assistance at https://getsupport.apple.com/x $5 off",
)


def pick(phrases: tuple[str, ...], position: Column) -> Column:
    """Phrase number ``position`` modulo the length of the list."""
    listed = F.array(*[F.lit(p) for p in phrases])
    return F.element_at(listed, (position % len(phrases) + 1).cast("int"))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_pick(phrases: tuple[str, ...], position: str) -> str:
    return f"({sql_list(phrases)})[CAST(({position}) % {len(phrases)} + 1 AS INTEGER)]"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, text, lang, source): documents with a customer phrase in front."""
    return texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.concat(pick(CUSTOMER_PHRASES, F.col("doc_id")), F.lit("\n"), F.col("text")).alias("text"),
        "lang",
        "source",
    )


REQUESTS_SQL = f"""requests AS (
  SELECT doc_id AS request_id,
         {sql_pick(CUSTOMER_PHRASES, 'doc_id')} || chr(10) || text AS text, lang, source
  FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, author_id, text): conversations with phrases per role."""
    conv, turn = F.col("conv_id"), F.col("turn")
    customer = pick(CUSTOMER_PHRASES, conv * 5 + turn)
    agent = pick(REPLY_PHRASES, conv * 3 + turn)
    phrase = F.when(F.col("role") == "assistant", agent).otherwise(customer)
    author = (
        F.when(F.col("role") == "assistant", "AppleSupport")
        .when(F.col("role") == "system", "system")
        .otherwise(F.concat(F.lit("cust_"), conv.cast("string")))
    )
    return texts(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        author.alias("author_id"),
        F.concat(phrase, F.lit("\n"), F.col("text")).alias("text"),
    )


TURNS_SQL = f"""turns AS (
  SELECT conv_id, turn, role,
         CASE role WHEN 'assistant' THEN 'AppleSupport' WHEN 'system' THEN 'system'
              ELSE 'cust_' || conv_id END AS author_id,
         CASE WHEN role = 'assistant' THEN {sql_pick(REPLY_PHRASES, 'conv_id * 3 + turn')}
              ELSE {sql_pick(CUSTOMER_PHRASES, 'conv_id * 5 + turn')} END || chr(10) || text AS text
  FROM conversations)"""


#: Turns that a conversation may have; more are an error, not another conversation's number.
MOST_TURNS = 10_000_000


def turn_number() -> Column:
    """One integer per (conv_id, turn)."""
    conv, turn = F.col("conv_id"), F.col("turn")
    number = conv * F.lit(MOST_TURNS).cast("long") + turn
    return F.when((turn >= 0) & (turn < MOST_TURNS), number).otherwise(F.raise_error(F.lit("turn out of range")))


def replies(spark: SparkSession, sf_dir: str, answers: bool = True) -> DataFrame:
    """(case_id, conv_id, customer_text, agent_text): every customer turn with the answer to it.

    Without ``answers`` the answers' texts aren't moved, and there is no ``agent_text``."""
    from deskloom.operators.threads import with_next

    brand = (F.col("role") == "assistant").alias("brand")
    said = turns(spark, sf_dir).select("conv_id", "turn", brand, "text")
    if not answers:
        said = said.withColumn("text", F.when(~F.col("brand"), F.col("text")))
    answered = ~F.col("brand") & F.col("next_brand")
    following = ["brand", "text"] if answers else ["brand"]
    return with_next(said, "conv_id", "turn", following, keep=answered).select(
        turn_number().alias("case_id"),
        F.col("conv_id"),
        F.col("text").alias("customer_text"),
        *([F.col("next_text").alias("agent_text")] if answers else []),
    )


REPLIES_SQL = f"""{TURNS_SQL},
adjacent AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
replies AS (
  SELECT conv_id * {MOST_TURNS} + turn AS case_id, conv_id, text AS customer_text, next_text AS agent_text
  FROM adjacent WHERE role <> 'assistant' AND next_role = 'assistant')"""


# A parametric cue table in the vocabulary of the generated prose: languages as labels.
LANGUAGE_CUES = {
    "de": [" die ", " der ", "ung", "keit", " und "],
    "en": [" the ", " of ", "tion", " and ", " was "],
    "es": [" el ", "ción", " los ", " que ", "mente"],
    "fr": [" le ", " une ", "eux", "è", " qui "],
}
LANGUAGES = ("de", "en", "es", "fr")
