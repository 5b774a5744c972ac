"""Secret scans with DataFrame operations only: candidates, features and a random forest as one expression.

Words are searched for candidate strings; their features (length, character transitions, dictionary coverage, path,
neighbouring words) go through a random forest that was trained on labelled findings to tell secrets from false
positives (digests, identifiers, paths, numbers, names). The forest becomes nested conditions, so nothing is exploded,
joined or run in Python on executors.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import free_name

#: Words of code, configuration and prose that secrets rarely have in them.
DICTIONARY = (
    "access account address admin agent alpha apache application archive assets backup base beta binary block branch "
    "build bundle cache change check class client cluster commit common component config content context controller "
    "core count create customer data database debug default delete demo deploy device digest directory document domain "
    "download dummy element email encode engine error event example export factory field file filter folder format "
    "function gateway global group handler hash header history home host image import index info input instance "
    "interface internal item javascript kernel language layer library license list local login long main manager map "
    "master message method model module name network node number object option order output package page param parent "
    "password path payload platform plugin policy port private process product production profile program project "
    "property provider public python query random record release remote replace report repository request resource "
    "response result return root sample schema script search secret server service session setting source spark "
    "staging static status storage store stream string style system table target task temp template test text "
    "thread time token tool type update upload user utils value vendor version view web window worker your"
).split()
#: Names that announce a secret, and names that announce something else.
ANNOUNCES = "token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|key"
DENIES = "commit|sha|sha1|sha256|md5|checksum|digest|hash|uuid|guid|id|ref|rev|revision|build|version|etag|file|path|url|see|order|invoice|isbn|serial|ticket"
FEATURES = (
    "length", "turns", "digits", "uppers", "hex", "distinct", "entropy", "vowels", "dictionary", "slashes", "extension",
    "parted", "number", "before_secret", "before_other", "assigned", "quoted", "prefix", "after_plain",
)
#: A word, and the string in it that may be a secret.
WORD, CANDIDATE = r"\s+", r"[A-Za-z0-9_+/=.~-]{8,}"
TRIMMED, NAMED = r"^[=.~/-]+|[.~/-]+$", r"^[A-Za-z_.-]{1,40}=(?=.{8})"
#: Characters of a candidate, and of one behind a name that announces a secret and a sign.
LONG, SHORT = 12, 8
ANNOUNCED = rf"({ANNOUNCES})[\"']?\s*(:=|=>|[:=])\s*[\"'`]?$"


def _share(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def feature_columns(value: Column, word: Column, before: Column, far: Column, after: Column, lead: Column) -> list[Column]:
    """FEATURES of a candidate from its word, the two words before it, the one after it (null: none) and what is ahead in the word."""
    size = F.greatest(F.length(value), F.lit(1))
    chars = F.split(value, "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / size)
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    ahead = F.lower(F.concat_ws(" ", far, before, lead))
    sign = F.concat_ws("", before, lead)
    return [
        size.cast("double"),
        F.regexp_count(value, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) / size,
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        _is(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        F.size(F.array_distinct(chars)) / size,
        entropy,
        _share(F.lower(value), "[aeiou]"),
        _share(F.lower(value), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"),
        _share(value, "/") * size,
        _is(value.rlike(r"\.[a-z]{1,4}$")),
        _is(value.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")),
        _is(value.rlike("^[0-9.-]+$")),
        _is(ahead.rlike(rf"(?<![a-z])[a-z_.-]*({ANNOUNCES})[\"']?\s*(:=|=>|[:=])?\s*[\"'`]?$")),
        _is(ahead.rlike(rf"(?<![a-z])({DENIES})[\"']?\s*[:=#]?\s*[\"'`]?$")),
        _is(sign.rlike("[:=]\\s*[\"'`]?$|[\"'`]$")),
        _is(word.rlike("[\"'`]")),
        _is(value.rlike("^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|AIza|glpat-|npm_|eyJ)")),
        _is(after.rlike("^[a-z.,;:!?]+$")),
    ]


def _structure(value: Column, word: Column, before: Column, far: Column, after: Column, lead: Column) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(feature_columns(value, word, before, far, after, lead), FEATURES, strict=True)))


def _within(array: Column, body) -> Column:
    """body(array) with array evaluated once: inside a lambda it would be again for every element."""
    return F.element_at(F.transform(F.array(array), body), 1)


def candidates(text: Column) -> Column:
    """Array of (value, word, before, far, after, lead, nth) of all candidate strings in the words of a text.

    lead is what is ahead of the candidate in its word, from the candidate string before it on.

    A candidate has LONG characters or more, in a word with a digit or near a name that announces a secret and a sign; or
    SHORT characters or more right behind such a name and sign.
    """

    def of(words: Column, i: Column) -> Column:
        word = F.get(words, i)
        parts = F.struct(F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)).alias("runs"), F.split(word, CANDIDATE).alias("between"))

        def one(run: Column, ahead: Column) -> Column:
            value = F.regexp_replace(F.regexp_replace(run, TRIMMED, ""), NAMED, "")
            lead = F.concat(ahead, F.call_function("substring_index", run, value, F.lit(1)))
            return F.struct(value.alias("value"), word.alias("word"), F.get(words, i - 1).alias("before"), F.get(words, i - 2).alias("far"), F.get(words, i + 1).alias("after"), lead.alias("lead"), i.alias("nth"))

        def all_of(p: Column) -> Column:
            ahead = lambda k: F.concat(F.coalesce(F.get(p["runs"], k - 1), F.lit("")), F.get(p["between"], k))
            return F.transform(p["runs"], lambda run, k: one(run, ahead(k)))

        return _within(parts, all_of)

    def found(words: Column) -> Column:
        def wanted(w: Column, i: Column) -> Column:
            sign = F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1), w)
            named = sign.rlike(rf"(?i)({ANNOUNCES})[\"']?\s*[:=]")
            return F.when((F.length(w) >= SHORT) & ((F.length(w) >= LONG) & w.rlike("[0-9]") | named) & w.rlike(CANDIDATE), i)

        at = F.filter(F.transform(words, wanted), lambda i: i.isNotNull())

        def long_enough(c: Column) -> Column:
            ahead = F.lower(F.concat_ws(" ", c["far"], c["before"], c["lead"]))
            return (F.length(c["value"]) >= LONG) | (F.length(c["value"]) >= SHORT) & ahead.rlike(ANNOUNCED)

        return F.filter(F.flatten(F.transform(at, lambda i: of(words, i))), long_enough)

    return _within(F.split(text, WORD), found)


#: A text without it has no candidate.
MAY_HOLD = rf"[0-9]|(?i:{ANNOUNCES})[\"']?\s*[:=]"


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None
    value: float = 0.0


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Node:
    if depth == 0 or len(y) < 6 or y.min() == y.max():
        return Node(value=float(y.mean()))
    best = (1e-9, -1, 0.0)
    base = y.mean() * (1 - y.mean()) * len(y)
    for f in rng.permutation(x.shape[1])[: max(1, int(x.shape[1] ** 0.5) + 1)]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(at):
            continue
        left, right = ones[at - 1], ones[-1] - ones[at - 1]
        gain = base - (left * (1 - left / at) + right * (1 - right / (len(y) - at)))
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
    if best[1] < 0:
        return Node(value=float(y.mean()))
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], _grow(x[low], y[low], rng, depth - 1), _grow(x[~low], y[~low], rng, depth - 1))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 5) -> list[Node]:
    """A random forest: each tree on a bootstrap sample, each split among a random part of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        out.append(_grow(x[own], y[own], rng, depth))
    return out


def probability(forest: list[Node], features: Column) -> Column:
    """The mean of the trees' leaves, as conditions on the fields of features."""

    def walk(n: Node) -> Column:
        return F.lit(n.value) if n.feature < 0 else F.when(features[FEATURES[n.feature]] <= n.cut, walk(n.below)).otherwise(walk(n.above))

    return reduce(Column.__add__, (walk(t) for t in forest)) / len(forest)


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, str, str, str, str, int]]:
    """(value, word, before, far, after, label): n findings drawn from rules for secrets (1) and false positives (0)."""
    rng = random.Random(seed)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["an", "er", "on", "the", "in", "re", "nd", "ha", "ti", "st", "ou", "ble", "ment", "ung", "keit", "que", "cion", "ado", "eau", "tion", "sch", "ver"]

    def pick(chars: str, low: int, high: int | None = None) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(low, high or low)))

    def plain() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."])

    def hexes(size: int) -> str:
        s = hashlib.sha512(str(rng.random()).encode()).hexdigest()[:size]
        return s.upper() if rng.random() < 0.15 else s

    secret = [
        lambda: hexes(rng.choice([24, 32, 40, 40, 48, 64])), lambda: pick(base62, 20, 48), lambda: pick(base62 + "+/", 40),
        lambda: "AKIA" + pick(base62[:26] + "0123456789", 16), lambda: "ghp_" + pick(base62, 36), lambda: "sk_live_" + pick(base62, 24),
        lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(base62, 24), lambda: "AIza" + pick(base62 + "_-", 35),
        lambda: "eyJ" + pick(base62, 20, 30) + "." + pick(base62 + "_-", 40, 60) + "." + pick(base62 + "_-", 30, 43),
        lambda: pick(base62 + "_-.~", 14, 24), lambda: "glpat-" + pick(base62, 20), lambda: "npm_" + pick(base62, 36),
        lambda: pick(base62[:52], 14, 32), lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(7, 12))),
        lambda: pick(base62, 8, 11), lambda: rng.choice(syllables) + rng.choice(syllables).title() + pick("0123456789", 4, 6),
    ]
    lettered = {12, 13, 14, 15}  # candidates only behind a name and a sign
    known = {3, 4, 5, 6, 7, 8, 10, 11}
    names = ["token", "secret", "password", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "aws_secret_access_key", "private_key", "pwd", "key", "TOKEN", "API_KEY", "Bearer"]
    other_names = ["commit", "sha256", "md5", "checksum", "digest", "uuid", "id", "build", "version", "etag", "file", "path", "ref", "rev", "order", "invoice", "serial", "url", "hash"]
    other = [
        lambda: hexes(rng.choice([32, 40, 64])), lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), lambda: pick("0123456789", 12, 20),
        lambda: "/".join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 5))) + rng.choice([".py", ".txt", ".json", ".go", "/v2", "2"]),
        lambda: ".".join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 4))) + str(rng.randint(0, 99)),
        lambda: "".join(rng.choice(DICTIONARY).title() for _ in range(rng.randint(2, 4))) + str(rng.randint(1, 99)),
        lambda: "_".join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 4))) + "_" + str(rng.randint(1, 999)),
        lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(4, 9))) + rng.choice(["", "1", "2024"]),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: f"{pick('0123456789', 2)}.{rng.choice(DICTIONARY)}{rng.randint(0, 9)}.example.com", lambda: f"{rng.randint(1, 255)}.{rng.randint(100, 255)}.{rng.randint(100, 255)}.{rng.randint(10, 255)}",
    ]
    holders = ["your-token-here-1234", "xxxxxxxxxxxxxxxx0000", "example_password_123", "test-secret-key-0001", "changeme12345678", "1234567890123456", "AAAAAAAAAAAAAAAAAAAA1", "dummy_api_key_12345", "placeholder_token_1", "0000000000000000000000000000000000000000"]
    settings = [w for w in DICTIONARY if len(w) >= SHORT] + ["required", "optional", "disabled", "enabled_by_default", "keyboard", "undefined", "none_given", "see_below", "rotated_daily", "not_set_yet"]
    out = []
    for k in range(n):
        style = rng.random()
        if k % 2 == 0:
            kind = rng.randrange(len(secret))
            value, label, name = secret[kind](), 1, rng.choice(names)
            if kind in known and rng.random() < 0.3:
                out.append((value, value, plain(), plain(), plain(), 1))
                continue
        else:
            label, kind = 0, rng.randrange(len(other) + 3)
            if kind == len(other) + 2:  # a setting behind such a name
                value, name = rng.choice(settings), rng.choice(names)
                ahead = rng.choice([(plain(), name + rng.choice([":", "="])), (name, rng.choice([":", "="]))])
                out.append((value, value, ahead[1], ahead[0], plain(), 0))
                continue
            if kind > len(other):
                value = "".join(rng.choice(syllables) for _ in range(rng.randint(6, 10)))
                out.append((value, value, plain(), rng.choice(names) + rng.choice([":", "="]), plain(), 0))
                continue
            if kind == len(other):
                value, name = rng.choice(holders), rng.choice(names)
            else:
                value, name = other[kind](), rng.choice(other_names)
                if rng.random() < 0.4 and kind:
                    end = rng.choice(["", ",", "."])
                    out.append((value, value + end, plain(), plain(), plain(), 0))
                    continue
        quote = rng.choice(['"', '"', "'", ""])
        if style < 0.5:
            out.append((value, f"{quote}{value}{quote}", rng.choice(["=", ":", ":="]), name, plain(), label))
        elif style < 0.75:
            out.append((value, f"{quote}{value}{quote}", name + rng.choice([":", "="] if label and kind in lettered else [":", "=", ""]), plain(), plain(), label))
        else:
            out.append((value, f"{name}={quote}{value}{quote}", plain(), plain(), plain(), label))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, str, int]], trees: int = 15, depth: int = 6) -> list[Node]:
    """A forest fitted on labelled findings, whose number bounds what the driver holds."""
    rows = spark.createDataFrame(findings, "value string, word string, before string, far string, after string, label int")
    made = rows.select(_structure(*(F.col(c) for c in ("value", "word", "before", "far", "after")), F.call_function("substring_index", F.col("word"), F.col("value"), F.lit(1))).alias("f"), "label")
    got = made.select("f.*", "label").collect()
    x = np.array([r[:-1] for r in got], float)
    return grow_forest(x, np.array([r[-1] for r in got], float), trees, depth)


def with_findings(docs: DataFrame, forest: list[Node], least: float = 0.5, name: str = "findings") -> DataFrame:
    """docs with an array of (nth, value, score) of the secrets in text: candidates whose score is least or more.

    nth is the word's place. Null, empty and candidate-free texts get an empty array, repeated secrets one entry each
    time; every other column stays, whatever its name, but one called name, which is replaced.
    """

    def scored(c: Column) -> Column:
        value, word = c["value"], c["word"]
        return F.struct(value.alias("value"), c["nth"].alias("nth"), _structure(value, word, c["before"], c["far"], c["after"], c["lead"]).alias("f"))

    found = F.transform(
        F.transform(candidates(F.coalesce(F.col("text"), F.lit(""))), scored),
        lambda c: F.struct(c["nth"].alias("nth"), c["value"].alias("value"), probability(forest, c["f"]).alias("score")),
    )
    found = F.when(F.col("text").rlike(MAY_HOLD), F.filter(found, lambda c: c["score"] >= least))
    return docs.withColumn(name, F.coalesce(found, F.array().cast("array<struct<nth:int,value:string,score:double>>")))


def secrets(docs: DataFrame, forest: list[Node], least: float = 0.5) -> DataFrame:
    """(doc_id, nth, secret, score): a row for each secret found in docs(doc_id, text)."""
    rows = with_findings(docs.select("doc_id", "text"), forest, least)
    # outer: else the optimiser adds a filter on the array's size, which would be made twice
    rows = rows.select("doc_id", F.explode_outer("findings").alias("f")).where("f IS NOT NULL")
    return rows.select("doc_id", "f.nth", F.col("f.value").alias("secret"), "f.score")


def redacted(docs: DataFrame, forest: list[Node], least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; n_chars, if there, follows. The columns and rows are those of docs."""
    hidden = free_name(docs, "findings")
    rows = with_findings(docs, forest, least, hidden)
    found = F.array_distinct(F.transform(hidden, lambda c: c["value"]))
    found = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))  # else one that is part of another would break it
    text = F.when(F.size(hidden) > 0, F.aggregate(found, F.col("text"), lambda t, s: F.replace(t, s, F.lit(mark)))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(hidden) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
