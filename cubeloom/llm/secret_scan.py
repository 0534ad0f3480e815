"""Secret scans with a random forest that removes false positives; DataFrame functions only.

Candidates are runs of 16 to 512 token characters holding a digit. A random forest looks at each: its length, the
transitions between character classes, the share of it that dictionary fragments cover, what the path and the
neighbouring words say. It is trained on labelled findings (a DataFrame of the same columns) with the DataFrame API of
Spark's library; its trees are then written as CASE expressions, so scoring is part of the scan's own projection:
candidates stay in an array on their row, and there is no shuffle, UDF or join.

Nulls: a null text has no candidates; a null path counts as an empty one; labelled findings with a null value or label
are not used. Repeated rows are scanned each. Longer runs than 512 characters are taken in pieces of 512; texts of any
length are read whole. An empty table gives no rows. A column of the result's name is replaced; all others stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm._common import unused

TOKEN = r"[A-Za-z0-9+/_\-]"
#: A candidate starts where no token character precedes it, or right after 512 others; a digit is near enough to be seen.
CANDIDATE = rf"((?:(?<!{TOKEN})|\G)(?={TOKEN}{{0,511}}[0-9]){TOKEN}{{16,512}})"
CONTEXT = 48
#: Fragments that prose, code names and placeholders are made of.
FRAGMENTS = (
    "example sample dummy fake test placeholder changeme your here insert todo none null true false default config version release build model "
    "the and ing ion tion ent ati for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat ell ble der ung sch ich ein cht ado ent que"
).split()
NAMES = r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
HARMLESS = r"(?i)(?:sha-?\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|example|sample|placeholder|dummy|fake|isbn|order|invoice|phone|id)"
FEATURES = ("length", "transitions", "distinct", "digits", "upper", "covered", "hex", "prefixed", "assigned", "named", "harmless", "quoted", "test_path", "runs")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Numbers of a candidate: doubles, none of them null for a value that isn't."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    size = F.greatest(F.length(value), F.lit(1))
    steps = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"
    return {
        "length": F.length(value).cast("double"),
        "transitions": _share(value, steps),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64)),
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "covered": (F.length(value) - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(FRAGMENTS, key=lambda w: (-len(w), w))), ""))) / size,
        "hex": flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "prefixed": flag(value.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^(?:sk|pk|rk)_(?:live|test)_|^xox[abprs]-|^glpat-|^AIza|^eyJ")),
        "assigned": flag(before.rlike(r"""[=:]\s*["'`]?$""")),
        "named": flag(before.rlike(NAMES + r"""["']?\s*(?:[=:]\s*|\s)["'`]?$""")),
        "harmless": flag(before.rlike(HARMLESS + r"""\W{0,3}$""")),
        "quoted": flag(before.rlike(r"""["'`]$""") & after.rlike(r"""^["'`]""")),
        "test_path": flag(path.rlike(r"(?i)(?:^|[/_.-])(?:tests?|examples?|fixtures?|docs?|samples?|mocks?)(?:[/_.-]|$)")),
        "runs": _share(value, r"(.)\1"),
    }


def fit_forest(findings: DataFrame, *, trees: int = 25, depth: int = 6, seed: int = 7, max_rows: int = 20_000) -> list[str]:
    """The trees as text, trained on at most max_rows labelled findings (value, before, after, path, label 0/1)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.where(F.col("value").isNotNull() & F.col("label").isin(0, 1))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.orderBy(F.xxhash64("value", "before", "after", "path"), "value").limit(max_rows)
    rows = rows.select(F.col("label").cast("double").alias("label"), *(c.alias(n) for n, c in features(F.col("value"), text("before"), text("after"), text("path")).items()))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.coalesce(1))
    return re.split(r"Tree \d+ \(weight [^)]*\):\n", model.toDebugString)[1:]


def _tree(lines: list[str], value) -> Column:
    """CASE expression of a tree printed as nested If / Else lines."""
    line = lines.pop(0).strip()
    if found := re.match(r"Predict: (\S+)", line):
        return F.lit(float(found[1]))
    number, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes = _tree(lines, value)
    lines.pop(0)  # Else
    no = _tree(lines, value)
    return F.when(value(FEATURES[int(number)]) <= float(bound), yes).otherwise(no)


def vote(forest: list[str], value) -> Column:
    """Share of the trees that vote for a secret; value(name) is a feature's column."""
    votes = [_tree([x for x in tree.split("\n") if x.strip()], value) for tree in forest]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total / len(votes)


def scan(docs: DataFrame, forest: list[str], *, text_col="text", path_col: str | None = None, threshold: float = 0.5, out="secrets") -> DataFrame:
    """docs with an array of the secrets found: start (characters, from 0), value, kind, score. In text order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    cand, part, rows = unused(docs, "_candidates", "_parts", "_rows")
    found = docs.withColumn(cand, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)))
    # the text between candidates, only where there are any
    found = found.withColumn(part, F.when(F.size(cand) > 0, F.split(text, CANDIDATE, -1)))
    context = F.transform(
        F.col(cand),
        lambda v, i: F.struct(
            v.alias("value"),
            F.right(F.get(F.col(part), i), F.lit(CONTEXT)).alias("before"),
            F.substring(F.get(F.col(part), i + 1), 1, CONTEXT).alias("after"),
            F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda a, k: a + F.length(F.get(F.col(part), k)) + F.when(k < i, F.length(F.get(F.col(cand), k))).otherwise(0)).alias("start"),
        ),
    )
    measured = F.transform(context, lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), c["before"].alias("before"), *(x.alias(n) for n, x in features(c["value"], c["before"], c["after"], path).items())))
    found = found.withColumn(rows, F.when(F.size(cand) > 0, measured))
    kind = lambda r: (
        F.when(r["value"].rlike("^(?:AKIA|ASIA)"), "access_key").when(r["prefixed"] == 1.0, "token").when(r["before"].rlike(r"(?i)pass|pwd"), "password").when(r["named"] == 1.0, "token").otherwise("other")
    )
    scored = F.transform(F.col(rows), lambda r: F.struct(r["start"].alias("start"), r["value"].alias("value"), kind(r).alias("kind"), vote(forest, lambda n: r[n]).alias("score")))
    kept = F.filter(scored, lambda s: s["score"] >= threshold)
    return found.withColumn(out, F.coalesce(kept, F.expr("cast(array() as array<struct<start:int,value:string,kind:string,score:double>>)"))).drop(cand, part, rows)


def redact(scanned: DataFrame, *, text_col="text", secrets_col="secrets", mark="[SECRET]") -> DataFrame:
    """The scanned rows with each secret's characters in the text replaced by the mark; without secrets_col."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    step = lambda a, s: F.struct((s["start"] + F.length(s["value"])).alias("at"), F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("done"))
    whole = F.aggregate(F.col(secrets_col), start, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(secrets_col) > 0, whole).otherwise(text)).drop(secrets_col)


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings drawn by rule: random keys in the places where keys stand, and what is mistaken for them
    (checksums, commits, identifiers, placeholders, words with digits)."""
    n = F.col("id")
    draw = lambda salt: F.sha2(F.concat_ws("-", n.cast("string"), F.lit(salt)), 512)
    hexes = lambda k, salt="a": F.substring(draw(salt), 1, k)
    mixed = lambda k, salt="b": F.substring(F.regexp_replace(F.base64(F.unhex(draw(salt))), "[+/=]", "x"), 1, k)
    upper = lambda k, salt="c": F.substring(F.translate(F.upper(F.base64(F.unhex(draw(salt)))), "+/=0189", "ABC2345"), 1, k)
    digits = lambda salt, k: (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(9 * 10 ** (k - 1))) + 10 ** (k - 1)).cast("string")
    words = ["the", "value", "of", "and", "report", "section", "nicht", "para", "dans", "item", "note"]
    pick = lambda values, salt: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(values))).cast("int"))
    prose = F.concat_ws(" ", pick(words, "p1"), pick(words, "p2"), F.lit(""))
    name = pick(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret"], "name")
    sign = pick(["=", " = ", ": ", " = \"", "=\"", ": '"], "sign")
    close = F.when(sign.endswith('"'), '" ').when(sign.endswith("'"), "' ").otherwise(" ")
    harmless = pick(["commit ", "sha1 ", "md5: ", "checksum=", "sha256:", "etag: ", "uuid ", "order ", "revision "], "harmless")
    length = F.element_at(F.array(*(F.lit(k) for k in (18, 20, 24, 32, 40))), (F.pmod(F.xxhash64(n, F.lit("len")), F.lit(5)) + 1).cast("int"))
    word = F.concat(*(pick(["tion", "the", "able", "ing", "ver", "con", "ment", "para", "ung", "ent", "ation"], f"w{k}") for k in range(5)))
    kinds = [  # value, before, label
        (F.concat(F.lit("AKIA"), upper(16)), prose, 1),
        (F.concat(F.lit("ghp_"), mixed(36)), prose, 1),
        (F.concat(F.lit("sk_live_"), mixed(24)), F.concat(prose, name, sign), 1),
        (hexes(length), F.concat(prose, name, sign), 1),
        (mixed(length), F.concat(prose, name, sign), 1),
        (hexes(length), F.concat(prose, name, sign), 1),
        (hexes(pick([32, 40, 64], "l2")), F.concat(prose, harmless), 0),
        (hexes(pick([32, 40, 64], "l3")), prose, 0),
        (F.concat_ws("-", hexes(8, "u"), hexes(4, "v"), hexes(4, "w"), hexes(4, "x"), hexes(12, "y")), F.concat(prose, harmless), 0),
        (F.concat(word, digits("n", 2)), F.concat(prose, F.when(n % 2 == 0, F.concat(name, sign)).otherwise("")), 0),
        (F.concat(F.lit("example_"), word, F.lit("1234")), F.concat(prose, name, sign), 0),
        (F.repeat(pick(["x", "0", "1", "X"], "r"), 20), F.concat(prose, name, sign), 0),
        (F.concat(F.lit("2024-"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("-build-"), digits("d", 8)), prose, 0),
    ]
    value = before = label = None
    for k, (v, b, x) in enumerate(kinds):
        here = n % len(kinds) == k
        value = F.when(here, v) if value is None else value.when(here, v)
        before = F.when(here, b) if before is None else before.when(here, b)
        label = F.when(here, x) if label is None else label.when(here, x)
    path = pick(["src0", "web/page", "app/config", "docs/readme", "tests/fixtures", ""], "path")
    after = F.concat(F.when(before.endswith(sign), close).otherwise(" "), pick(words, "after"))
    return spark.range(rows).select(value.alias("value"), before.alias("before"), after.alias("after"), path.alias("path"), label.alias("label"))
