"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame operations alone.

Everything about a document happens within its row: no join, no shuffle, no Python on the executors. The forest is a
few flat arrays that array functions walk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Runs of 16 or more that have a digit or are all capitals, or something that a key word is set to.
RUN = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
CAPITALS = r"(?<![A-Za-z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])"
SET = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth)[\"']?[:=]+[\"']?([^\s\"']{6,})"
#: The words before a value that stands alone end in a key word with a separator, which may be a word of its own.
ASSIGNED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth)[\"']? ?[:=]+[\"']?$"
#: What SET finds, but up to a separator; and names of keys that something is set to, which are no runs.
PART = SET.replace("([^", "([^,;&")
NAME = r"(?i)(?<![A-Za-z0-9_+/\-])(?=[a-z0-9_\-]*(?:pass|pwd|secret|token|key|auth|credential|bearer|login))[a-z]+[0-9]{0,2}(?:[_\-][a-z]+[0-9]{0,2})*[\"']?[:=]+(?=[\"']?[^\s\"'])"
#: Tokens of several parts; passwords in addresses; the inside of key blocks.
DOTTED = r"[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{10,})+"
USER = r"://[^\s/:@]*:([^\s/@]{3,})@"
BLOCK = r"(?s)-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s*+(.{6,20000}?)\s*-----END"
#: Texts that match none of this have no candidates.
QUICK = r"(?i)[A-Za-z0-9_+/\-]{16}|pass(?:word|wd|phrase)?[\"']?\s?[:=]|pwd[\"']?\s?[:=]|secret[\"']?\s?[:=]|token[\"']?\s?[:=]|key[\"']?\s?[:=]|auth[\"']?\s?[:=]|://[^\s/:@]*:[^\s/@]{3,}@"
#: Of a longer word, a candidate's features see so many characters to each side.
NEAR = 100
#: Words near a candidate that speak for and against a secret.
FOR = r"(?i)pass|pwd|secret|token|key|auth|credential|bearer|login"
AGAINST = r"(?i)example|sample|dummy|placeholder|commit|sha1|sha256|md5|checksum|digest|uuid|guid|order|tracking|invoice|isbn|card|phone|version|build"
ISSUED = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^sk_(?:live|test)_|^xox[abprs]-|^AIza|^glpat-|^SG\."
#: Common words and word parts of the dictionary, in order of length.
DICTIONARY = (
    "placeholder", "production", "directory", "documents", "different", "password", "resource", "database", "document", "language", "question", "internet",
    "example", "default", "function", "private", "project", "release", "version", "station", "another", "because", "through", "between", "account",
    "sample", "secret", "source", "change", "master", "branch", "commit", "system", "server", "client", "domain", "string", "number", "object", "public", "module",
    "value", "token", "admin", "local", "build", "table", "index", "image", "class", "there", "their", "which", "would", "about", "other", "ingly", "ation",
    "test", "user", "data", "file", "path", "main", "name", "node", "page", "part", "your", "here", "this", "that", "with", "from", "have", "tion", "ment", "ness", "able", "heit", "keit", "lich", "isch",
    "abc", "xyz", "foo", "bar", "qux", "lib", "src", "doc", "img", "the", "and", "for", "ing", "ion", "ent", "est", "ers", "ate", "ble", "ous", "ung", "sch", "ein", "ver", "que", "eau", "eux", "ado", "des", "los", "las", "ate", "ter", "con", "pre", "pro", "der", "den",
    "th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ea",
)
FEATURES = ("length", "digits", "upper", "lower", "changes", "transitions", "distinct", "dictionary", "hexadecimal", "issued", "path", "for", "against", "vowels", "doubled", "key_value")
TREES, DEPTH, LABELLED, TRIES = 24, 6, 6000, 5


def transitions() -> list[float]:
    """log2 of how likely each of 26 letters follows each of 26, row by row, over the dictionary's words with one added."""
    counts = np.ones((26, 26))
    for word in DICTIONARY:
        for x, y in zip(word, word[1:]):  # noqa: B905
            counts[ord(x) - 97, ord(y) - 97] += 1
    return np.log2(counts / counts.sum(axis=1, keepdims=True)).ravel().tolist()


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double") / F.length(value)


def likelihood(value: Column) -> Column:
    """Mean of `transitions` over the pairs of neighbouring characters of a value's first 64, those that are no two letters counting as -8."""
    table = constants(transitions(), "double")
    low = F.lower(F.substring(value, 1, 64))
    place = lambda i: F.ascii(F.substring(low, i, F.lit(1))) - 97
    letter = lambda x: (x >= 0) & (x < 26)
    pair = lambda i: F.when(letter(place(i)) & letter(place(i + 1)), F.element_at(table, (place(i) * 26 + place(i + 1) + 1).cast("int"))).otherwise(F.lit(-8.0))
    last = F.greatest(F.length(low) - 1, F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), last), F.lit(0.0), lambda total, i: total + pair(i)) / last


def features(word: Column, value: Column, before: Column, after: Column) -> Column:
    """The FEATURES of a candidate: `value` within `word`, the words before it and the one after."""
    lead = F.concat_ws(" ", before, F.call_function("substring_index", word, value, F.lit(1)))
    around = F.concat_ws(" ", before, word, after)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        F.length(value).cast("double"), _share(value, "[0-9]"), _share(value, "[A-Z]"), _share(value, "[a-z]"),
        _share(value, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        likelihood(value), F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.length(value),
        1.0 - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")).cast("double") / F.length(value),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), flag(value.rlike(ISSUED)), flag(word.rlike(r"[/\\].*[/\\]|://|\.[a-z]{2,4}\b")),
        flag(lead.rlike(FOR)), flag(around.rlike(AGAINST)), _share(value, "(?i)[aeiouy]"), _share(value, r"(.)(?=\1)"), flag(word.rlike(SET)),
    )


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(word, value, before, after, secret): findings as they are met in text, made from digests of their numbers.

    Secrets are issued keys, hexadecimal and base-64 strings beside key words; the others are checksums and ids,
    numbers, paths, placeholders, names and shouted words.
    """
    digests: dict[str, Column] = {}
    parts: dict[str, Column] = {}

    def h(salt: str) -> Column:
        """A digest of the number, held as a column of its own."""
        digests[f"h_{salt}"] = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
        return F.col(f"h_{salt}")

    def part(name: str, value: Column) -> Column:
        parts[name] = value
        return F.col(name)

    digit = lambda salt, k: F.conv(F.substring(h(salt), 1, 6), 16, 10).cast("long") % k
    pick = lambda salt, *words: F.element_at(F.array(*map(F.lit, words)), (digit(salt, len(words)) + 1).cast("int"))
    base64 = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "[\r\n]", "")
    letters = lambda salt: F.translate(F.upper(F.regexp_replace(base64(salt), "[+/=]", "Q")), "0189", "2345")
    prose = part("prose", pick("p", "the", "and", "of ther", "is", "with an", "von der", "de la", "que los", "a note", "then", ""))
    keyword = part("keyword", pick("k", "password", "token", "secret", "api_key", "auth token", "access key", "login"))
    sign = part("sign", pick("s", "=", ":", "is", "=", ""))
    sounds = F.array(*map(F.lit, ("th", "er", "on", "an", "ing", "re", "tion", "ed", "st", "en", "ver", "sch", "que", "eau", "ado", "ous")))
    sound = lambda salt, k: F.element_at(sounds, (F.conv(F.substring(h(salt), 2 * k + 1, 2), 16, 10).cast("int") % 16 + 1).cast("int"))
    syllables = lambda salt: part(f"syllables_{salt}", F.concat(*(sound(f"y{salt}", k) for k in range(8))))
    quoted = lambda c: F.when(digit("q", 2) == 0, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    some_hex = part("some_hex", F.substring(h("x"), 1, (16 + digit("l", 49)).cast("int")))
    some_64 = part("some_64", F.substring(base64("b"), 1, (20 + digit("l", 40)).cast("int")))
    key = part("key", F.concat(pick("i", "AKIA", "ASIA"), F.substring(letters("a"), 1, 16)))
    issued = part("issued", F.concat(pick("j", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"), F.substring(F.regexp_replace(base64("c"), "[+/=]", "x"), 1, 30)))
    with_key = part("with_key", F.concat_ws(" ", prose, keyword, sign))
    user = part("user", F.concat(pick("v", "https://", "ftp://", "postgres://", "redis://"), pick("w", "user", "admin", "deploy", "bot"), F.lit(":")))
    human = part("human", F.concat(pick("m", "Tr0ub", "S3cr3t", "hunt", "P4ss", "Zx9", "kora!"), F.substring(some_64, 1, 4), pick("n", "!x9", "&3", "W0rd", "77", "_q")))
    jwt = part("jwt", F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(F.regexp_replace(base64("e"), "[+/=]", "x"), 1, 17)), F.concat(F.lit("eyJ"), F.substring(F.regexp_replace(base64("g"), "[+/=]", "y"), 1, 30)), F.substring(F.regexp_replace(base64("h"), "[+/=]", "-"), 1, 43)))
    block = part("block", F.concat_ws("\n", F.concat(F.lit("MII"), F.substring(base64("e"), 1, 61)), F.substring(base64("g"), 1, 64), F.substring(base64("h"), 1, 21)))
    begin = part("begin", F.concat(F.lit("-----BEGIN "), pick("u", "RSA ", "EC ", "OPENSSH ", ""), F.lit("PRIVATE KEY-----")))
    kinds = [
        # tokens of several parts, passwords in addresses and after key words, key blocks; hosts, file names, versions and embedded images
        (jwt, jwt, prose, 1), (F.concat(user, human, pick("y", "@db.host.org/x", "@10.0.0.7:5432", "@site.net")), human, prose, 1), (F.concat(keyword, pick("z", ":", "="), human), human, with_key, 1), (block, block, begin, 1),
        (F.concat_ws(".", F.concat(syllables("a"), F.lit("service1")), F.concat(syllables("b"), F.lit("cluster")), F.lit("internalzone")),) * 2 + (F.concat_ws(" ", prose, pick("n", "host", "at", "server", "")), 0),
        (F.concat(syllables("a"), F.lit("-"), digit("x", 900).cast("string"), pick("r", "_final.", "_version2.", "_draft10."), syllables("b"), F.lit("ing")),) * 2 + (F.concat_ws(" ", prose, pick("n", "file", "build", "")), 0),
        (F.concat(F.lit("data:image/png;base64,"), some_64), some_64, prose, 0),
        (F.concat(user, pick("o", "password", "changeme", "PASSWORD", "xxxx"), F.lit("@host.org")), pick("o", "password", "changeme", "PASSWORD", "xxxx"), prose, 0),
        # word, value, words before, secret
        (key, key, prose, 1), (issued, issued, prose, 1), (quoted(some_hex), some_hex, with_key, 1), (quoted(some_64), some_64, with_key, 1),
        (F.concat(pick("k", "password", "token", "secret", "pwd", "apikey"), F.lit("="), some_hex), some_hex, prose, 1),
        (F.concat(pick("k", "password", "passwd", "PASSWORD", "secret"), pick("s", "=", ":"), F.substring(some_64, 1, 14)), F.substring(some_64, 1, 14), prose, 1),
        (some_hex, some_hex, F.concat_ws(" ", prose, pick("n", "commit", "sha256", "md5", "checksum", "digest", "build")), 0),
        (F.concat_ws("-", *(F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),) * 2 + (F.concat_ws(" ", prose, pick("n", "uuid", "id", "order", "")), 0),
        (F.translate(F.substring(h("d"), 1, 16), "abcdef", "123456"),) * 2 + (F.concat_ws(" ", prose, pick("n", "card", "phone", "order", "", "isbn")), 0),
        (F.concat(pick("r", "/usr/lib/", "src/main/", "https://site.org/a/", "docs/img/"), syllables("w"), F.lit("/v2/"), F.substring(h("f"), 1, 8), pick("e", ".png", ".html", ".py")),) * 2 + (prose, 0),
        (F.concat(pick("k", "password", "token", "api_key"), F.lit("="), pick("o", "your_password_here", "changeme123", "example-token-0001", "xxxxxxxxxxxxxxxx", "<password>", "1234567890123456")), pick("o", "your_password_here", "changeme123", "example-token-0001", "xxxxxxxxxxxxxxxx", "<password>", "1234567890123456"), prose, 0),
        (F.upper(syllables("w")),) * 2 + (prose, 0), (F.concat(syllables("w"), digit("z", 100).cast("string")),) * 2 + (prose, 0),
        (F.concat_ws("_", syllables("w"), F.lit("name2"), syllables("y")),) * 2 + (F.concat_ws(" ", prose, pick("n", "key", "", "")), 0),
    ]
    after = pick("t", "the", "and", "then.", "de", "")
    made = [F.struct(w.alias("word"), v.alias("value"), b.alias("before"), after.alias("after"), F.lit(secret).alias("secret")) for w, v, b, secret in kinds]
    one = F.when(F.col("id") % len(made) == 0, made[0])
    for k, x in enumerate(made[1:], 1):
        one = one.when(F.col("id") % len(made) == k, x)
    rows = common.hold(spark.range(0, n, 1, 2), "h", F.struct(*(v.alias(k) for k, v in digests.items()))).select("id", "h.*")
    for name, value in parts.items():
        rows = common.hold(rows, name, value)
    return common.hold(rows, "k", one).select("id", "k.*")


def constants(values: Sequence[float], kind: str) -> Column:
    """An array of numbers that the optimiser folds into one constant; thousands of literals would take it many seconds."""
    return F.expr(f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)")


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in flat arrays, numbered from 1 as array functions do. A leaf points at itself."""

    feature: list[int]
    limit: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]

    def score(self, x: Column) -> Column:
        """Mean over the trees of the share of secrets in the leaf that a feature array reaches."""
        feature, limit, left, right, value = (constants(v, k) for v, k in ((self.feature, "int"), (self.limit, "double"), (self.left, "int"), (self.right, "int"), (self.value, "double")))
        step = lambda at: F.when(F.element_at(x, F.element_at(feature, at)) <= F.element_at(limit, at), F.element_at(left, at)).otherwise(F.element_at(right, at))
        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, lambda at, _: step(at))
        total = F.aggregate(constants(self.roots, "int"), F.lit(0.0), lambda s, root: s + F.element_at(value, leaf(root)))
        return total / float(len(self.roots))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
    """Trees on bootstrap samples; each node tries TRIES features and takes the cut that lowers the Gini impurity most."""
    r = np.random.default_rng(seed)
    nodes: list[list] = []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]

    def node(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([1, 0.0, at + 1, at + 1, float(y[rows].mean())])
        best = (1e-9, None)
        if level < depth and 0 < y[rows].sum() < len(rows):
            for j in r.choice(x.shape[1], TRIES, replace=False):
                below = x[rows, j][:, None] <= cuts[j]
                n, s = below.sum(axis=0), (below & (y[rows] == 1)[:, None]).sum(axis=0)
                m, t = len(rows) - n, y[rows].sum() - s
                ok = (n >= 3) & (m >= 3)
                if ok.any():
                    # impurity of a side of n with s ones: s (n - s) / n
                    drop = np.where(ok, y[rows].sum() * (1 - y[rows].mean()) - s * (n - s) / np.maximum(n, 1) - t * (m - t) / np.maximum(m, 1), -1)
                    k = int(drop.argmax())
                    if drop[k] > best[0]:
                        best = (drop[k], (int(j), float(cuts[j][k])))
        if best[1] is not None:
            j, limit = best[1]
            below = x[rows, j] <= limit
            left, right = node(rows[below], level + 1), node(rows[~below], level + 1)
            nodes[at][:4] = [j + 1, limit, left, right]
        return at + 1

    roots = [node(r.integers(0, len(x), len(x)), 0) for _ in range(trees)]
    return Forest(*map(list, zip(*nodes, strict=True)), roots)


def learn(findings: DataFrame) -> Forest:
    """A forest from labelled findings (id, word, value, before, after, secret), whose number the caller bounds."""
    rows = findings.select("id", "secret", features(F.col("word"), F.col("value"), F.col("before"), F.col("after")).alias("x")).collect()
    rows.sort(key=lambda r: r["id"])
    return grow(np.array([r["x"] for r in rows]), np.array([r["secret"] for r in rows]))


def found(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc, text, found) of `docs`: each row as a struct, its text, null as the empty one, and all candidates as (at, word, value, score).

    `at` is the number of the word from 0, or of the word after the opening of a key block. A word may hold several. What is
    computed once a row is held, so that a text is split once; texts that QUICK rules out are not split.
    """
    back = lambda i: F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1))
    alone = lambda w: F.regexp_replace(w, r"^[\"']+|[\"'.,;:)\]}>]{1,20}$", "")
    is_candidate = lambda w: (F.length(w) >= 10) & (w.rlike(RUN) & w.rlike("[0-9]") | w.rlike(CAPITALS) | w.rlike(SET) | w.rlike(USER))
    is_value = lambda w, i: (F.length(w) >= 6) & F.substring(F.get("words", i - 1), -2, 2).rlike("[:=]") & back(i).rlike(ASSIGNED) & (F.length(alone(w)) >= 6)
    every = lambda w, pattern, group: F.regexp_extract_all(w, F.lit(pattern), F.lit(group))
    bare = lambda values: F.transform(values, lambda v: F.regexp_replace(v, r"[.,;:)\]}>]{1,20}$", ""))
    none = F.array().cast("array<string>")

    def values(word: Column) -> Column:
        digits = word.rlike("[0-9]")
        runs = F.when(digits, every(F.regexp_replace(word, NAME, " "), RUN, 0)).otherwise(none)
        dotted = F.when(digits, every(word, DOTTED, 0)).otherwise(none)
        return F.array_distinct(F.concat(bare(every(word, SET, 1)), bare(every(word, PART, 1)), runs, every(word, CAPITALS, 0), dotted, every(word, USER, 1)))

    def near(word: Column, value: Column) -> Column:
        start = F.greatest(F.call_function("instr", word, value) - NEAR, F.lit(1))
        return F.when(F.length(word) <= 2 * NEAR, word).otherwise(F.substring(word, start, F.length(value) + 2 * NEAR))

    def of_word(i: Column) -> Column:
        word = F.get("words", i)
        before = F.array_join(F.slice("words", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
        after = F.coalesce(F.get("words", i + 1), F.lit(""))
        # A value that stands alone is seen as if it were joined to its key word.
        own = F.when(is_value(word, i), F.array(alone(word))).otherwise(none)
        seen = lambda v: F.when(is_value(word, i) & (v == alone(word)), F.concat(F.regexp_extract(back(i), ASSIGNED, 0), word)).otherwise(near(word, v))
        return F.transform(F.array_distinct(F.concat(own, values(word))), lambda v: F.struct(i.alias("at"), seen(v).alias("word"), v.alias("value"), before.alias("before"), after.alias("after")))

    def of_block(body: Column) -> Column:
        ahead = F.call_function("substring_index", F.col("text"), body, F.lit(1))
        at = (F.size(F.split(F.rtrim(ahead), SPACE))).cast("int")
        return F.struct(at.alias("at"), body.alias("word"), body.alias("value"), F.regexp_extract(ahead, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s*$", 0).alias("before"), F.lit("").alias("after"))

    rows = docs.select(F.struct("*").alias("doc")).withColumn("text", F.coalesce(F.col("doc.text"), F.lit("")))
    rows = common.hold(rows, "words", F.when(F.col("text").rlike(QUICK), F.split("text", SPACE)).otherwise(none))
    rows = common.hold(rows, "spots", F.filter(F.transform("words", lambda w, i: F.when(is_candidate(w) | is_value(w, i), i)), lambda i: i.isNotNull()))
    blocks = F.when(F.col("text").contains("PRIVATE KEY-----"), F.transform(every(F.col("text"), BLOCK, 1), of_block)).otherwise(F.array().cast("array<struct<at:int,word:string,value:string,before:string,after:string>>"))
    rows = common.hold(rows, "candidates", F.filter(F.concat(F.flatten(F.transform("spots", of_word)), blocks), lambda c: F.length(c["value"]) > 0)).drop("words", "spots")
    measured = F.transform("candidates", lambda c: F.struct(c["at"].alias("at"), c["word"].alias("word"), c["value"].alias("value"), features(c["word"], c["value"], c["before"], c["after"]).alias("x")))
    rows = common.hold(rows, "measured", measured).drop("candidates")
    return common.hold(rows, "found", F.transform("measured", lambda c: F.struct(c["at"].alias("at"), c["word"].alias("word"), c["value"].alias("value"), forest.score(c["x"]).alias("score")))).drop("measured")


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, word_index, value, score, secret): a row a candidate; `secret` is the forest's verdict.

    A text without candidates, or null, has no rows, and an empty table gives none. Repeated rows of `docs` are each
    reported; a null id stays null; columns but doc_id and text are not read.
    """
    rows = found(docs.select(common.doc_id(), "text"), forest).select("doc.doc_id", F.explode("found").alias("x"))
    return rows.select("doc_id", F.col("x.at").cast("long").alias("word_index"), "x.value", "x.score", (F.col("x.score") >= 0.5).alias("secret"))


def redact(docs: DataFrame, forest: Forest, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret's value replaced wherever it stands in its text, and n_chars, if there is one, brought up to date.

    No row goes; null texts stay null; all other columns stay as they are, whatever their names. An empty table gives an
    empty result.
    """
    values = F.array_distinct(F.transform(F.filter("found", lambda c: c["score"] >= 0.5), lambda c: c["value"]))
    # Longer ones first: a value may hold another one.
    values = F.transform(F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    rows = common.hold(found(docs, forest), "secrets", values).drop("found")
    hidden = F.aggregate("secrets", F.col("text"), lambda t, v: F.replace(t, v, F.lit(mask)))
    rows = common.hold(rows, "hidden", F.when(F.size("secrets") > 0, hidden).otherwise(F.col("doc.text"))).drop("text")

    def column(name: str) -> Column:
        if name == "text":
            return F.col("hidden").alias("text")
        own = F.col("doc")[name]
        if name == "n_chars":
            return F.when(F.size("secrets") > 0, F.length("hidden").cast(docs.schema["n_chars"].dataType)).otherwise(own).alias(name)
        return own.alias(name)

    return rows.select(*map(column, docs.columns))
