"""Quality rules as weak supervision (operator 13), DataFrame functions only.

Each rule looks at counts of a text and votes that it is good or bad, or abstains. Nobody knows which votes are right. Expectation
maximisation over all documents estimates, per rule, how often it is right on good and on bad texts, and the share of good texts:

* E: the posterior that a text is good, given its votes. Abstentions say nothing.
* M: shares of right votes among good and among bad texts, weighted by the posteriors.

Votes enter the rounds as one code a text, so a round reads the codes with their numbers of texts: ``3 ** rules`` rows at most (59,049),
whatever the corpus. Posteriors are weighted in whole billionths and added up exactly, so that results don't depend on the order of rows.
A text is kept if its posterior is ``KEEP`` or more: one odd vote may be outweighed, where all-must-pass would drop the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import table
from tessella.plans.storage import stage

WINDOW = 8
ROUNDS = 8
KEEP = 0.5
UNIT = 1_000_000_000
#: Shares of right votes on good and on bad texts, and the share of good texts. Rules are careful at the start: they are wrong about two good
#: texts in a hundred and catch three bad ones in ten. The estimates stay within bounds, so that a rule never settles a text alone.
START = {"good": 0.98, "bad": 0.3, "share": 0.85}
LEAST, MOST = {"good": 0.97, "bad": 0.2, "share": 0.02}, {"good": 0.995, "bad": 0.9, "share": 0.98}

#: (name, good, bad) over the counts of ``text_counts``, in whole numbers; neither: the rule abstains.
RULES = (
    ("length", "n_words >= 50", "n_words < 20"),
    ("word_length", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("letters", "100 * n_letters >= 85 * word_chars", "100 * n_letters < 75 * word_chars"),
    ("lettered_words", "100 * n_lettered >= 90 * n_words", "100 * n_lettered < 80 * n_words"),
    ("capitals", "100 * n_upper <= 20 * n_letters", "100 * n_upper > 40 * n_letters"),
    ("calls", "100 * n_calls <= 2 * n_words", "10 * n_calls > n_words"),
    ("lines", "n_lines >= 2 AND n_dup_lines = 0", "100 * n_dup_lines > 30 * n_lines"),
    ("repeats", "n_words >= 20 AND n_repeat_words = 0", "100 * n_repeat_words > 20 * n_words"),
    ("distinct", "n_words >= 20 AND 100 * n_distinct >= 30 * n_words", "n_words >= 20 AND 100 * n_distinct < 15 * n_words"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_calls", "n_lettered", "n_distinct")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words within windows of ``WINDOW`` words that occur twice or more in the text, all occurrences; windows are compared by 64-bit hashes."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = let(hashes, lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def covered(at: Column) -> Column:
        gap = lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, gap), F.lit(0), lambda s, n: s + n)

    def shared(order: Column) -> Column:
        other = lambda x, k: (x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"])
        twice = F.transform(order, lambda x, k: F.when(F.coalesce(other(x, k), x["h"] == F.get(order, k + 1)["h"], x["h"] == F.get(order, k - 1)["h"]), x["i"]))
        return let(F.sort_array(F.filter(twice, lambda i: i.isNotNull())), covered)

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, shared))

    return let(windows, count)


def text_counts(text: Column) -> Column:
    """Struct of ``COUNTS`` (bigint) of a whole text; null counts as empty. Letters and capitals are Unicode's, words and lines are parted as bytes."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: F.translate(text, chars, "")
    inner = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    blank = " \t\n\x0b\f\r"

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("n_lettered"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, blank, "") != "")

    def together(of: Column) -> Column:
        found = {n: of["w"][n] for n in ("n_words", "n_repeat_words", "n_lettered", "n_distinct")} | {n: of["l"][n] for n in ("n_lines", "n_dup_lines")}
        found |= {n: of[n] for n in COUNTS if n not in found}
        return F.struct(*[found[n].cast("bigint").alias(n) for n in COUNTS])

    whole = F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.length(without(blank)).alias("word_chars"),
        (F.length(text) - F.length(without("#*$%&|<>"))).alias("n_symbols"), (F.length(text) - F.length(without("!"))).alias("n_calls"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("n_letters"), F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"),
    )
    return let(whole, together)


def vote_code(rules: tuple = RULES) -> Column:
    """The votes as one number, a digit to the base 3 per rule: 0 abstains, 1 good, 2 bad; a rule whose conditions both hold votes bad."""
    code = F.lit(0).cast("bigint")
    for k, (_, good, bad) in enumerate(rules):
        code = code + F.when(F.expr(bad), 2).when(F.expr(good), 1).otherwise(0) * 3**k
    return code


def votes_of(code: Column, rules: int) -> Column:
    """The votes of a code, as an array."""
    powers = F.array(*[F.lit(3**k).cast("bigint") for k in range(rules)])
    return F.transform(powers, lambda p: (F.floor(code / p) % 3).cast("int"))


def posterior(votes: Column, model: dict) -> Column:
    """Probability that a text of these votes is good."""
    numbers = lambda kind: F.array(*[F.lit(float(x)) for x in model[kind]])
    product = lambda start, factors: F.aggregate(factors, F.lit(float(start)), lambda s, x: s * x)
    one = F.lit(1.0)
    good = product(model["share"], F.zip_with(votes, numbers("good"), lambda v, a: F.when(v == 1, a).when(v == 2, one - a).otherwise(one)))
    bad = product(1 - model["share"], F.zip_with(votes, numbers("bad"), lambda v, b: F.when(v == 1, one - b).when(v == 2, b).otherwise(one)))
    return good / (good + bad)


def _share(right: int, of: int, kind: str, before: float) -> float:
    return min(MOST[kind], max(LEAST[kind], right / of)) if of else before


def fit(codes: DataFrame, rules: int, rounds: int = ROUNDS) -> dict:
    """The model after ``rounds`` rounds over ``codes`` (votes, n). A rule without votes keeps its start; without texts all do."""
    model = {"good": [START["good"]] * rules, "bad": [START["bad"]] * rules, "share": START["share"]}
    for _ in range(rounds):
        good = F.round(posterior(F.col("votes"), model) * UNIT).cast("decimal(10,0)")
        weighed = codes.select(F.col("n").cast("decimal(19,0)").alias("n"), good.alias("g"), F.posexplode("votes").alias("rule", "vote"))
        weighed = weighed.select("rule", "vote", (F.col("n") * F.col("g")).alias("g"), (F.col("n") * (UNIT - F.col("g"))).alias("b"))
        sums = weighed.groupBy("rule", "vote").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect()  # three a rule
        of = lambda side, rule, votes: sum(int(r[side]) for r in sums if r["rule"] == rule and r["vote"] in votes)
        model = {
            "good": [_share(of("g", k, (1,)), of("g", k, (1, 2)), "good", model["good"][k]) for k in range(rules)],
            "bad": [_share(of("b", k, (2,)), of("b", k, (1, 2)), "bad", model["bad"][k]) for k in range(rules)],
            "share": _share(of("g", 0, (0, 1, 2)), of("g", 0, (0, 1, 2)) + of("b", 0, (0, 1, 2)), "share", model["share"]),
        }
    return model


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES, rounds: int = ROUNDS, keep: float = KEEP) -> tuple[DataFrame, dict]:
    """(``code``, ``id``, the ``COUNTS``, ``posterior``, ``kept`` per row; the model).

    Null texts count as empty; they and texts without words have all counts 0 and are judged by their votes like others. Repeated rows
    and null ids are judged alike and count as often as they occur. An empty table gives an empty result; other columns are ignored,
    whatever their names. Texts are counted whole; a row's arrays of words and windows are in memory at once.
    """
    counted = df.select(F.col(id_col).alias("id"), text_counts(F.col(text_col)).alias("c")).select("id", "c.*")
    counted = stage(counted.withColumn("code", vote_code(rules)), "quality-counts")
    codes = counted.groupBy("code").agg(F.count("*").alias("n"))
    codes = stage(codes.withColumn("votes", votes_of(F.col("code"), len(rules))), "vote-codes")
    model = fit(codes, len(rules), rounds)
    # 3 ** rules codes at most
    judged = counted.join(F.broadcast(codes.select("code", posterior(F.col("votes"), model).alias("posterior"))), "code")
    return judged.withColumn("kept", F.col("posterior") >= keep), model


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents, whether the base rules fail, and the verdict of the votes. A null text has no words and fails."""
    judged, _ = judge(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return judged.select(F.col("id").alias("doc_id"), *COUNTS[:5], failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), F.round("posterior", 6).alias("posterior"))


def _op13_sql() -> str:
    vote = lambda k: f"((code // {3**k}) % 3)"
    m = len(RULES)
    steps = [f"m0 AS (SELECT {START['share']}::DOUBLE AS share, {', '.join(f'{START["good"]}::DOUBLE AS a{k}, {START["bad"]}::DOUBLE AS b{k}' for k in range(m))})"]
    good = "share" + "".join(f" * CASE {vote(k)} WHEN 1 THEN a{k} WHEN 2 THEN 1 - a{k} ELSE 1 END" for k in range(m))
    bad = "(1 - share)" + "".join(f" * CASE {vote(k)} WHEN 1 THEN 1 - b{k} WHEN 2 THEN b{k} ELSE 1 END" for k in range(m))
    post = f"({good}) / (({good}) + ({bad}))"
    bound = lambda x, kind: f"least({MOST[kind]}::DOUBLE, greatest({LEAST[kind]}::DOUBLE, {x}))"
    for r in range(ROUNDS):
        steps.append(f"p{r} AS (SELECT code, n * round({post} * {UNIT})::HUGEINT AS g, n * ({UNIT} - round({post} * {UNIT})::HUGEINT) AS b FROM codes, m{r})")
        new = []
        for k in range(m):
            new.append(f"CASE WHEN coalesce(sum(g) FILTER ({vote(k)} > 0), 0) = 0 THEN any_value(a{k}) ELSE {bound(f'coalesce(sum(g) FILTER ({vote(k)} = 1), 0)::DOUBLE / (sum(g) FILTER ({vote(k)} > 0))::DOUBLE', 'good')} END AS a{k}")
            new.append(f"CASE WHEN coalesce(sum(b) FILTER ({vote(k)} > 0), 0) = 0 THEN any_value(b{k}) ELSE {bound(f'coalesce(sum(b) FILTER ({vote(k)} = 2), 0)::DOUBLE / (sum(b) FILTER ({vote(k)} > 0))::DOUBLE', 'bad')} END AS b{k}")
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT {bound('sum(g)::DOUBLE / (sum(g) + sum(b))::DOUBLE', 'share')} AS share, {', '.join(new)} FROM p{r}, m{r})")
    code = " + ".join(f"{3**k} * CASE WHEN {bad_} THEN 2 WHEN {good_} THEN 1 ELSE 0 END" for k, (_, good_, bad_) in enumerate(RULES))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT row, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
h AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, s) AS n FROM g) WHERE n > 1),
r AS (SELECT row, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM h) GROUP BY row),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             len(regexp_replace(text, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters, len(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
             len(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_calls, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_lettered, len(list_distinct(w))::BIGINT AS n_distinct
      FROM w LEFT JOIN r USING (row)),
v AS MATERIALIZED (SELECT *, ({code})::BIGINT AS code FROM c),
codes AS MATERIALIZED (SELECT code, count(*)::HUGEINT AS n FROM v GROUP BY code),
{", ".join(steps)}
SELECT doc_id, {", ".join(COUNTS[:5])}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {post} >= {KEEP} AS kept, round({post}, 6) AS posterior
FROM v, m{ROUNDS}
"""


OP13_SQL = _op13_sql()
