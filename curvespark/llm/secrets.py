"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything runs as DataFrame functions: one pass of the pattern marks a document's candidates, which become an array of structs, the forest is a sum of
CASE expressions over their features, and no row leaves its partition. The forest sees a candidate's length, its character transitions, the dictionary
words in it, whether it is a path, and the words beside it; the labels that it is fitted on come from other things: exact formats and the alphabet of the value.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespark.plans.lineage import stored

#: The forest is fitted on the labelled findings of about so many documents, chosen by a hash of their texts, and on so many findings at most, those with the smallest hash.
FITTED_ON = 50_000
MAX_LABELLED = 20_000
THRESHOLD = 0.5
REDACTED = "[SECRET]"
_TREES, _DEPTH, _SEED = 20, 6, 7
_LEFT, _RIGHT = 40, 24
#: So many candidates are summed up at once, so that the time grows hardly faster than their number.
_RUN_OF = 256

_KEYWORDS = "token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?|private[_-]?key|bearer"
#: What follows a key's name: the sign stands first in the pattern, so that most places fail at once, and the name is looked for behind it.
_SCHEME = r"(?:(?i:bearer|basic|token)\s{1,3})?"
_SIGN = rf"[:=][:=]?>?\s{{0,3}}[\"']?{_SCHEME}"
_ASSIGNED = rf"[:=](?<=(?i:{_KEYWORDS})[\"']?\s{{0,3}}[:=])(?![:=]?>?\s{{0,3}}[\"']?-----BEGIN )[:=]?>?\s{{0,3}}[\"']?{_SCHEME}"
#: A private key as a whole, whatever its length, with header lines (``Proc-Type: ...``), its line ends real or escaped.
_PEM_HEADERS = r"(?:(?:\s|\\[rn])*+[A-Za-z][A-Za-z0-9\-]*+:[^\r\n\\]*+){0,64}+"
_PEM = rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----{_PEM_HEADERS}[A-Za-z0-9+/=\s\\]*+(?:-----END [A-Z ]{{0,30}}PRIVATE KEY-----)?"
_RUN = r"(?<![A-Za-z0-9_+/.\-])(?=[A-Za-z_+/.\-]*+[0-9])[A-Za-z0-9_+/.\-]{16,}+={0,2}"
_KEY = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,})"
CANDIDATE = rf"{_ASSIGNED}[^\s\"'|]{{6,}}+|{_KEY}|{_RUN}|{_PEM}"
_PREFIX = rf"^{_SIGN}"
#: What every candidate holds, quick to look for: texts without it have none.
_NEEDED = r"[0-9:=]|A[KS]IA|AIza|xox[abprs]-|gh[pousr]_|-----BEGIN"
_PROVIDER = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-|^sk[-_][A-Za-z0-9_-]{20,}$|^AIza[0-9A-Za-z_-]{30,}$|^eyJ[A-Za-z0-9_-]+\.eyJ|^-----BEGIN"
_PLACEHOLDER = r"(?i)example|sample|dummy|fake|changeme|placeholder|your[_-]|x{4,}|\*{3,}|<[a-z_]+>|0{8,}|12345678|abcdefgh"
#: Formats of what is no secret: numbers of any kind, addresses, hosts, file names, dates, UUIDs.
_HARMLESS = r"^[0-9.\-/+_]+$|^[A-Za-z0-9._+\-]+@|^(?:[a-z0-9\-]+\.)+(?:com|net|org|edu|gov|io)\b|\.(?:html?|css|js|png|jpe?g|gif|pdf|txt|csv|json|xml|ya?ml|py|java|gz|zip)$|^\d{4}-\d\d-\d\d|^(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$"
#: Words that occur in identifiers, paths and hosts rather than in keys.
_DICTIONARY = (
    "mail http https www com net org edu info test tests example sample data file files image images static media page pages index main home user users admin config build "
    "version release source docs document license license public local server client host name path type list item value number string object class module package import export "
    "the and for with this that from have not are was you all can one our out get set new add key word text html json xml yaml csv pdf png jpg svg css lib src bin usr var etc opt tmp log logs"
).split()

FEATURES = ("length", "letter_digit", "lower_upper", "word_symbol", "repeats", "dictionary", "path", "source_path", "keyword_left", "hash_left", "example_left", "quoted", "mail_beside")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _features(c: Column, source: Column) -> list[Column]:
    """Numbers of a candidate: its length, its character transitions, dictionary words in it, paths, and what stands around it."""
    value, left, right = c["value"], c["left"], c["right"]
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    pieces = F.filter(F.split(F.lower(value), r"[^a-z]+"), lambda w: F.length(w) >= 3)
    known = F.aggregate(F.filter(pieces, lambda w: w.isin(_DICTIONARY)), F.lit(0), lambda s, w: s + F.length(w))
    is_true = lambda x: F.when(x, 1.0).otherwise(0.0)
    return [
        n,
        _count(value, r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])") / n,
        _count(value, r"[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        _count(value, r"[A-Za-z0-9](?=[^A-Za-z0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])") / n,
        _count(value, r"(.)(?=\1)") / n,
        known / n,
        is_true(value.rlike(r"^[./]|/.*/|\.[a-z]{2,4}$|\.(?:com|net|org)\b")),
        is_true(F.coalesce(source, F.lit("")).rlike(r"(?i)test|example|sample|fixture|doc")),
        is_true(left.rlike(rf"(?i)\b(?:{_KEYWORDS})\b")),
        is_true(left.rlike(r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|revision|hash|uuid|etag|isbn|phone|tel)\W{0,4}$")),
        is_true(left.rlike(r"(?i)\b(?:example|sample|dummy|fake|placeholder)\b")),
        is_true(left.rlike(r"[\"']$") | right.rlike(r"^[\"']")),
        is_true(left.rlike(r"@[\w.\-]*$") | right.rlike(r"^@")),
    ]


def _escaped(text: Column) -> Column:
    """The text without the two marks: they and the escape itself become the escape and a letter of their own kind."""
    return F.replace(F.replace(F.replace(text, F.lit("\x03"), F.lit("\x03\x04")), F.lit("\x01"), F.lit("\x03\x05")), F.lit("\x02"), F.lit("\x03\x06"))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\x03\x06"), F.lit("\x02")), F.lit("\x03\x05"), F.lit("\x01")), F.lit("\x03\x04"), F.lit("\x03"))


def _starts(lengths: Column) -> Column:
    """Running sums before each of an array of numbers: within runs, over the runs' sums, and both together."""
    empty = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.lit(0)), 1, 0).alias("starts"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN_OF).cast("int")), lambda k: F.aggregate(F.slice(lengths, k * _RUN_OF + 1, _RUN_OF), empty, step))
    firsts = F.aggregate(F.transform(runs, lambda r: r["at"]), empty, step, lambda s: s["starts"])
    return F.flatten(F.zip_with(runs, firsts, lambda r, first: F.transform(r["starts"], lambda x: x + first)))


def _with_candidates(docs: DataFrame, text_col: str, source: Column) -> DataFrame:
    """``docs`` and two columns: ``__before``, the text before the first candidate, and ``__found``, the candidates with the text after each, their place and features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.columns
    odd = text.rlike("[\x01-\x03]")
    marked = F.regexp_replace(F.when(odd, _escaped(text)).otherwise(text), CANDIDATE, "\x01$0\x02")
    # only a text that holds what every candidate holds is searched
    out = docs.select(*kept, odd.alias("__odd"), F.split(F.when(text.rlike(_NEEDED), marked).otherwise(F.lit("")), "\x01").alias("__parts"))
    restored = lambda x: F.when(F.col("__odd"), _plain(x)).otherwise(x)
    n = F.size("__parts")
    own = F.slice("__parts", 2, F.greatest(n - 1, F.lit(0)))
    joined = lambda first, many: F.replace(F.array_join(F.slice("__parts", first, many), ""), F.lit("\x02"), F.lit(""))

    def piece(part: Column, k: Column) -> Column:
        raw = F.substring_index(part, "\x02", 1)
        # every part but the first has seven characters or more, so a few of them hold what stands beside
        low = F.greatest(k + 1 - _LEFT // 6, F.lit(1))
        return F.struct(
            restored(raw).alias("raw"),
            restored(F.substring_index(part, "\x02", -1)).alias("rest"),
            F.right(restored(joined(low, k + 2 - low)), F.lit(_LEFT)).alias("left"),
            F.left(restored(F.concat(F.substring_index(part, "\x02", -1), joined(k + 3, F.lit(_RIGHT // 6)))), F.lit(_RIGHT)).alias("right"),
            F.regexp_extract(restored(raw), _PREFIX, 0).alias("prefix"),
        )

    before = F.when(n > 1, restored(F.get("__parts", F.lit(0)))).otherwise(text)
    out = out.select(*kept, before.alias("__before"), F.transform(own, piece).alias("__pieces"))
    lengths = F.concat(F.array(F.length("__before")), F.transform("__pieces", lambda p: F.length(p["raw"]) + F.length(p["rest"])))
    out = out.select(*kept, "__before", "__pieces", F.when(F.size("__pieces") > 0, F.slice(_starts(lengths), 2, F.size("__pieces"))).alias("__at"))

    def candidate(p: Column, at: Column) -> Column:
        return F.struct(
            (at + F.length(p["prefix"])).alias("start"),
            F.substring(p["raw"], F.length(p["prefix"]) + 1, F.length(p["raw"])).alias("value"),
            F.concat(p["left"], p["prefix"]).alias("left"),
            p["right"].alias("right"),
            p["prefix"].alias("prefix"),
            (p["prefix"] != "").alias("assigned"),
            p["rest"].alias("rest"),
        )

    found = F.when(F.size("__pieces") > 0, F.zip_with("__pieces", "__at", candidate))
    none = F.filter(F.transform("__pieces", lambda p: candidate(p, F.lit(0))), lambda p: F.lit(False))
    out = out.select(*kept, "__before", F.coalesce(found, none).alias("__found"))
    numbers = lambda c: F.struct(*(f.cast("double").alias(k) for f, k in zip(_features(c, source), FEATURES, strict=True)))
    return out.select(*kept, "__before", F.transform("__found", lambda c: F.struct(c.alias("c"), numbers(c).alias("f"))).alias("__found"))


def _each(found: DataFrame) -> DataFrame:
    """A row for each finding, ``x``. Not ``explode``, for which the optimiser would ask beforehand, by the pattern again, whether there is any."""
    return found.select(*(c for c in found.columns if c != "__found"), F.explode_outer("__found").alias("x")).where("x is not null")


def label_findings(found: DataFrame) -> DataFrame:
    """Labels for findings (column ``c``) whose kind is beyond doubt by what the forest doesn't see; the others are left out.

    True: provider formats, and values with an assignment sign of 16 characters or more, with letters and three digits, that draw on their alphabet as
    evenly as random ones do (entropy over 3.2 bits a character). False: numbers, hosts, mail addresses, file names, dates, UUIDs, placeholders,
    values of few different characters (under 2.5 bits), and hexadecimal numbers of a digest's length that nothing is assigned to.
    """
    value = F.col("c.value")
    n = F.length(value).cast("double")
    counts = F.transform(F.array_distinct(F.split(value, "")), lambda x: F.size(F.filter(F.split(value, ""), lambda y: y == x)) / n)
    entropy = F.when(n > 256, F.lit(None)).otherwise(F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)))  # long values are left to their formats
    mixed = value.rlike(r"^[A-Za-z0-9_+/=-]{16,}$") & value.rlike(r"[A-Za-z]") & (F.regexp_count(value, F.lit(r"[0-9]")) >= 3)
    harmless = value.rlike(_HARMLESS) | value.rlike(_PLACEHOLDER)
    random = F.when(mixed & (entropy > 3.2) & F.col("c.assigned"), 1.0)
    digest = value.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") & ~F.col("c.assigned")
    label = F.when(value.rlike(_PROVIDER) & ~value.rlike(_PLACEHOLDER), 1.0).when(harmless | digest | (entropy < 2.5), 0.0).otherwise(random)
    return found.withColumn("label", label).where("label is not null")


def fit_model(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """A random forest on findings with features ``f`` and a ``label``; None if there are not labels of both kinds."""
    rows = labelled.select("label", *(F.col("f")[k].alias(k) for k in FEATURES))
    rows = stored(rows.orderBy(F.xxhash64(*rows.columns)).limit(MAX_LABELLED), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    points = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=_TREES, maxDepth=_DEPTH, seed=_SEED, featureSubsetStrategy="sqrt").fit(points)


def forest_sql(model: RandomForestClassificationModel) -> str:
    """The forest as nested CASE expressions of a struct ``f``: the mean over its trees of the share of secrets in the leaf that a finding falls in."""

    def node(x) -> str:  # noqa: ANN001  a node in the JVM
        if x.subtreeDepth() == 0:
            share = x.impurityStats()
            no, yes = share.stats()[0], share.stats()[1]
            return f"{yes / (no + yes)!r}D"
        return f"CASE WHEN f.{FEATURES[x.split().featureIndex()]} <= {x.split().threshold()!r}D THEN {node(x.leftChild())} ELSE {node(x.rightChild())} END"

    trees = [node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}.0D"


def fit_forest(docs: DataFrame, text_col: str = "text", source_col: str | None = "source") -> str:
    """The score of a finding's features ``f``, as SQL, from the findings in about FITTED_ON documents that can be labelled.

    Without findings of both kinds: what stands beside a key's name is a secret, and what changes often between letters and digits.
    """
    share = int(1_000_000 * min(1.0, FITTED_ON / max(1, docs.count())))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(1_000_000)) < share)
    chosen = chosen.select(F.col(text_col).alias("text"), (F.col(source_col).cast("string") if source_col else F.lit("")).alias("source"))
    found = _each(_with_candidates(chosen, "text", F.col("source")).select("__found")).select("x.c", "x.f")
    model = fit_model(label_findings(found))
    if model is None:
        return "CASE WHEN f.keyword_left > 0 AND f.example_left = 0 OR f.letter_digit > 0.2 AND f.length >= 20 AND f.hash_left = 0 THEN 1.0D ELSE 0.0D END"
    return forest_sql(model)


def _scored(docs: DataFrame, text_col: str, source_col: str | None, forest: str) -> DataFrame:
    found = _with_candidates(docs, text_col, F.col(source_col).cast("string") if source_col else F.lit(""))
    score = f"CASE WHEN x.c.value LIKE '-----BEGIN %' THEN 1.0D ELSE {forest} END"  # few corpora have private keys for the forest to learn from
    scored = F.expr(f"transform(__found, x -> struct(x.c as c, {re.sub(r'\bf\.', 'x.f.', score)} as score))")
    return found.withColumn("__found", scored)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", forest: str | None = None) -> DataFrame:
    """``(doc_id, start, length, secret_sha256, score, is_secret)`` for each candidate: its place in code points and what the forest says of it.

    Null and empty texts have no candidates. Repeated rows are each searched. Null sources count as empty. ``forest`` is what ``fit_forest`` returns;
    it is fitted on ``docs`` if it isn't given.
    """
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(source_col).alias("source")] if source_col else []))
    source_col = "source" if source_col else None
    scored = _scored(wanted, "text", source_col, forest or fit_forest(wanted, "text", source_col))
    out = _each(scored.select("doc_id", "__found"))
    return out.select("doc_id", F.col("x.c.start").cast("long").alias("start"), F.length("x.c.value").cast("long").alias("length"), F.sha2("x.c.value", 256).alias("secret_sha256"), "x.score", (F.col("x.score") >= THRESHOLD).alias("is_secret"))


def redact_secrets(docs: DataFrame, text_col: str = "text", source_col: str | None = "source", forest: str | None = None) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``[SECRET]``; all rows stay, null texts stay null."""
    # the rows as one column, so that no name of theirs can clash
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"), (F.col(source_col).cast("string") if source_col else F.lit("")).alias("source"))
    scored = _scored(held, "text", "source", forest or fit_forest(docs, text_col, source_col))
    shown = lambda x: F.concat(x["c"]["prefix"], F.when(x["score"] >= THRESHOLD, F.lit(REDACTED)).otherwise(x["c"]["value"]), x["c"]["rest"])
    text = F.concat("__before", F.array_join(F.transform("__found", shown), ""))
    clean = F.when(F.col("text").isNotNull() & (F.size("__found") > 0), text).otherwise(F.col("text"))
    return scored.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
