"""Personal data by candidate gradient boosting, as column expressions throughout.

Base spans follow fixed patterns per kind (email, ip, card, phone) with checks;
matches that fail a check are dropped. Then base spans are masked, and high-recall
generators propose further spans in the rest of the text, written otherwise than
the base patterns allow. Each proposal is tried as every kind it may be, so
proposals overlap. Boosted trees score each on format and context; those above
their kind's calibrated threshold are accepted by falling score where no accepted
one touches them, within each run of spans that touch one another. What the base patterns find in the
masked text, as a number once hidden by a neighbour, is taken outright.
redact() replaces the very spans that find() lists.

The trees are trained on TRAIN_ROWS made-up candidates in context, drawn from
the templates below by hashes, and the thresholds on as many others. The fitted
trees become one nested CASE expression, so that a text is judged in the task
that reads it: nothing is shuffled and no Python runs on executors.

Null texts count as empty. Texts of any length are searched whole, and the time
grows in proportion to the text and its candidates, but for a run of proposals that
touch one another, whose time is the square of its length: patterns never backtrack
over more than they have read, and arrays are swept in parts. Repeated rows get
equal spans, extra columns are carried along whatever their names, an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The dealt patterns; possessive quantifiers and look-behinds change no match, only the time a failure takes.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CHECKS = {
    "email": "true",
    "ip": rf"{{m}} RLIKE r'^{OCTET}(?:\.{OCTET}){{3}}$'",
    "card": "length(translate({m}, ' -', '')) BETWEEN 13 AND 19 AND luhn_check(translate({m}, ' -', ''))",
    "phone": "length(translate({m}, '+ ().-', '')) BETWEEN 9 AND 15",
}
#: Generators of proposals: written-out addresses, and digits with any usual separators.
DOT, AT = r"\x20?[\[({]dot[\])}]\x20?|\x20dot\x20", r"\x20?[\[({]at[\])}]\x20?|\x20at\x20"
GENERATORS = {
    "written": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:@|{AT})[a-z0-9-]++(?:(?:\.|{DOT})[a-z0-9-]++)++",
    "phones": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "cards": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}(?![0-9])",
    "quads": r"(?<![0-9])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\.)\x20?[0-9]{1,3}){3}(?![0-9])",
    "digits": r"(?<![0-9])\+?\(?[0-9](?:(?:[\x20()._/-]|\[\.\]|\(\.\)){0,3}+[0-9]){3,}+(?![0-9])",
}
PROPOSED = {"written": ("email",), "phones": ("phone",), "cards": ("card",), "quads": ("ip",), "digits": ("ip", "card", "phone")}
#: Every match of a generator holds one of its hint; texts without it skip the generator.
HINTS = {
    "written": rf"(?i)(?:@|[\[({{]at[\])}}]\x20?|\x20at\x20)[a-z0-9-]++(?:\.|{DOT})[a-z0-9-]",
    "phones": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "cards": r"(?:[0-9]{4}[\x20-]?){3}[0-9]",
    "quads": r"(?:[0-9]{1,3}[\x20.()\[\]]{1,5}){3}[0-9]",
    "digits": r"[0-9](?:[\x20()._/\[\]-]{0,9}[0-9]){3}",
}
#: Stands for every character of a base span in the masked text; no pattern matches it.
MASK = "\u0001"
#: Texts are taken apart in pieces of so many characters, so that a span is cut out of its piece and not of the whole text.
PIECE = 1024
SPAN = "struct<start: bigint, end: bigint, kind: string, score: double>"

TRAIN_ROWS = 6000
TREES = 8
DEPTH = 4
CONTEXT = 24
#: Templates of made-up candidates by true kind. # is a digit, $ a digit that completes the check sum, ! one that breaks
#: it, O a number to 255, U one beyond, w some letters. The last group is of look-alikes.
TEMPLATES = {
    "email": ("www.##[at]wwww.www", "wwwww (at) wwwww (dot) www", "www [at] www [dot] www", "wwwww at wwwww dot www", "w.wwww{at}www{dot}www"),
    "ip": ("O[.]O[.]O[.]O", "O(.)O(.)O(.)O", "O . O . O . O"),
    "card": ("4###.####.####.###$", "5###/####/####/###$", "4###_####_####_###$", "3###  ######  ####$", "4### - #### - #### - ###$", "4##############$", "5### #### #### ###$"),
    "phone": ("(###) ###-####", "###-###-####", "###.###.####", "00## ### ######", "0## ######", "1-###-###-####", "### ### ####", "0#/## ## ## ##", "+1 (###) ###-####", "+## ### ######"),
    "": ("20##-0#-1#", "20##/0#/1# 1#", "978-#-##-######-#", "#.#.##.####", "########", "###############!", "17########", "U[.]O[.]O[.]U", "O.O.O.O.O", "####.####.####.###!", "4###/####/####/###!", "#.########", "#### ####", "### ### ###", "##-##-##-##-##", "wwww at www. www", "ww at wwwww. Dot www", "####_####", "#############", "##########", "20## 20## 20##", "1###-1###"),
}
BEFORE = {"email": ("mail ", "write to ", "", "www: "), "ip": ("host ", "ip ", "", "www "), "card": ("card ", "visa ", "pay by ", "", "www "), "phone": ("call ", "tel ", "phone: ", "", "www "), "": ("on ", "version ", "order ", "isbn ", "no. ", "", "www ", "id=")}
#: Features over m, the candidate; b and a, the text before and after; k, the kind it is tried as.
FEATURES = (
    *(f"cast({{k}} = '{kind}' AS double)" for kind in KINDS),
    "cast(length({m}) AS double)",
    "cast(length(regexp_replace({m}, '[^0-9]', '')) AS double)",
    "cast(size(split({m}, '[^0-9]+')) AS double)",
    "cast(length(regexp_extract({m}, '^[^0-9]*([0-9]+)', 1)) AS double)",
    "cast(length(regexp_extract({m}, '([0-9]+)[^0-9]*$', 1)) AS double)",
    "cast(length({m}) - length(translate({m}, '.', '')) AS double)",
    "cast(length({m}) - length(translate({m}, ' ', '')) AS double)",
    "cast(length({m}) - length(translate({m}, '-', '')) AS double)",
    "cast(length({m}) - length(translate({m}, '([', '')) AS double)",
    "cast(length({m}) - length(translate({m}, '/_', '')) AS double)",
    "cast(luhn_check(right(concat('0', regexp_replace({m}, '[^0-9]', '')), 19)) AS double)",
    rf"cast({{m}} RLIKE r'^{OCTET}(?:[^0-9]+{OCTET}){{3}}$' AS double)",
    "cast({m} RLIKE '(?i)[^a-z]at[^a-z]' AS double)",
    "cast({m} RLIKE '(?i)[^a-z]dot[^a-z]' AS double)",
    "cast({m} LIKE '%@%' AS double)",
    "cast(substring({m}, 1, 2) IN ('19', '20') AS double)",
    "cast({b} RLIKE '(?i)(tel|phone|call|fax|mobile)[^a-z]*$' AS double)",
    "cast({b} RLIKE '(?i)(card|visa|master|credit|pay by)[^a-z]*$' AS double)",
    "cast({b} RLIKE '(?i)(ip|host|server|addr)[^a-z]*$' AS double)",
    "cast({b} RLIKE '(?i)(mail|write to|contact)[^a-z]*$' AS double)",
    "cast({b} RLIKE '(?i)(version|order|isbn|no[.]|id)[^a-z]*$' AS double)",
    "cast({b} RLIKE '[A-Za-z0-9_=]$' AS double)",
    "cast({a} RLIKE '^[A-Za-z0-9_]' AS double)",
)


def filled(features: str, **names: str) -> str:
    for name, column in names.items():
        features = features.replace(f"{{{name}}}", column)
    return features


def made_up(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """(m, b, a, k, label): candidates filled from the templates, each tried as the kinds its generator proposes."""
    drawn = [(kind, t) for kind, ts in TEMPLATES.items() for t in ts]
    texts = F.lit([t for _, t in drawn])
    kinds = F.lit([k for k, _ in drawn])
    i = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(drawn))).cast("int") + 1
    df = spark.range(0, rows, 1, 4).select("id", F.element_at(texts, i).alias("t"), F.element_at(kinds, i).alias("true_kind"))

    def digit(c: Column, j: Column, of: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), j, F.lit(seed)), F.lit(of))

    def put(c: Column, j: Column) -> Column:
        letters = F.lit("abcdefghijklmnopqrstuvwxyz")
        return (
            F.when(c == "#", digit(c, j, 10).cast("string"))
            .when(c == "O", digit(c, j, 256).cast("string"))
            .when(c == "U", (digit(c, j, 700) + 256).cast("string"))
            .when(c == "w", F.substring(letters, digit(c, j, 26).cast("int") + 1, F.lit(1)))
            .otherwise(c)
        )

    def fill(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, ""), put), "")

    df = df.withColumn("m", fill(F.col("t")))
    plain = F.regexp_replace("m", "[^0-9]", "")
    right = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(plain, d))), 1)
    wrong = ((right.cast("int") + 1 + F.pmod(F.xxhash64("id"), F.lit(8))) % 10).cast("string")
    df = df.withColumn("m", F.when(F.col("m").endswith("$"), F.concat(F.expr("left(m, length(m) - 1)"), right)).when(F.col("m").endswith("!"), F.concat(F.expr("left(m, length(m) - 1)"), wrong)).otherwise(F.col("m")))
    before = F.lit("")
    for kind, options in BEFORE.items():
        pick = F.element_at(F.lit(list(options)), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(len(options))).cast("int") + 1)
        before = F.when(F.col("true_kind") == kind, fill(pick)).otherwise(before)
    written = F.col("m").rlike("(?i)[a-z]")
    tried = F.when(written, F.lit(list(PROPOSED["written"]))).otherwise(F.lit(list(PROPOSED["digits"])))
    df = df.select("id", "m", before.alias("b"), F.lit(" and").alias("a"), "true_kind", F.explode(tried).alias("k"))
    return df.withColumn("label", (F.col("k") == F.col("true_kind")).cast("double"))


def tree_sql(node, names: list[str]) -> str:
    """A fitted regression tree as a CASE expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"CASE WHEN {names[split.featureIndex()]} <= {split.threshold()!r}D THEN {tree_sql(node.leftChild(), names)} ELSE {tree_sql(node.rightChild(), names)} END"


def train(spark: SparkSession) -> dict:
    """The score as SQL over features f0, f1, ... of a struct x, and a threshold per kind."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = [f"f{i}" for i in range(len(FEATURES))]
    columns = [F.expr(filled(f, m="m", b="b", a="a", k="k")).alias(n) for f, n in zip(FEATURES, names)]
    rows = made_up(spark, TRAIN_ROWS, 1).select("label", *columns).coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.5, seed=1, featuresCol="features", labelCol="label").fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    own = [f"x.{n}" for n in names]
    total = " + ".join(f"{w!r}D * ({tree_sql(t._call_java('rootNode'), own)})" for t, w in zip(model.trees, model.treeWeights))
    score = f"1 / (1 + exp(-2 * ({total})))"
    held = made_up(spark, TRAIN_ROWS, 2).select("k", "label", F.struct(*columns).alias("x")).select("k", "label", F.expr(score).alias("score"))
    worst = held.groupBy("k").agg(F.max(F.when(F.col("label") == 0, F.col("score"))).alias("s")).collect()
    thresholds = dict.fromkeys(KINDS, 0.5) | {r["k"]: max(0.5, min(0.9, (r["s"] or 0.0) + 0.01)) for r in worst}
    return {"score": score, "thresholds": thresholds}


#: From `matches` and `around` to a struct per match. Lengths are summed in runs of 256, so that many matches in one text cost no square.
LOCATED = """
transform(flatten(aggregate(
    sequence(0, greatest(size(matches) - 1, 0) div 256),
    named_struct('at', 0L, 'out', cast(array() AS array<array<bigint>>)),
    (whole, run) -> aggregate(
        CASE WHEN size(matches) = 0 THEN cast(array() AS array<int>) ELSE sequence(run * 256, least(size(matches), (run + 1) * 256) - 1) END,
        named_struct('at', whole.at, 'starts', cast(array() AS array<bigint>)),
        (acc, i) -> named_struct('at', acc.at + length(around[i]) + length(matches[i]), 'starts', array_append(acc.starts, acc.at + length(around[i]))),
        acc -> named_struct('at', acc.at, 'out', array_append(whole.out, acc.starts))),
    whole -> whole.out)),
  (start, i) -> named_struct('m', matches[i], 'start', start, 'end', start + length(matches[i]), 'b', right(around[i], 24), 'a', left(around[i + 1], 8)))
"""


def swept(spans: str, touching: str) -> str:
    """The array of SPAN, sorted by start, with those that touch the last one held made one with it by `touching`, an expression over x and acc.held."""
    none = f"cast(array() AS array<{SPAN}>)"
    return f"""flatten(aggregate(
      CASE WHEN size({spans}) = 0 THEN cast(array() AS array<bigint>) ELSE sequence(0L, cast((size({spans}) - 1) div 256 AS bigint)) END,
      named_struct('held', cast(NULL AS {SPAN}), 'out', cast(array() AS array<array<{SPAN}>>)),
      (whole, run) -> aggregate(slice({spans}, cast(run * 256 + 1 AS int), 256),
        named_struct('held', whole.held, 'out', {none}),
        (acc, x) -> CASE WHEN acc.held IS NULL THEN named_struct('held', x, 'out', acc.out)
          WHEN x.start < acc.held.end THEN named_struct('held', {touching}, 'out', acc.out)
          ELSE named_struct('held', x, 'out', array_append(acc.out, acc.held)) END,
        acc -> named_struct('held', acc.held, 'out', array_append(whole.out, acc.out))),
      whole -> CASE WHEN whole.held IS NULL THEN whole.out ELSE array_append(whole.out, array(whole.held)) END))"""


#: Base spans that overlap count as one of the first's kind.
UNITED = "named_struct('start', acc.held.start, 'end', greatest(acc.held.end, x.end), 'kind', acc.held.kind, 'score', acc.held.score)"


def accepted(spans: str) -> str:
    """Of the array of SPAN, sorted by start, those that no better one touches which is accepted itself: by score, then length, then place.

    Only within a run of spans that touch one another are they compared.
    """
    group = f"ARRAY<{SPAN}>"
    runs = f"""flatten(aggregate(
      CASE WHEN size({spans}) = 0 THEN cast(array() AS array<bigint>) ELSE sequence(0L, cast((size({spans}) - 1) div 256 AS bigint)) END,
      named_struct('end', -1L, 'own', cast(array() AS {group}), 'out', cast(array() AS ARRAY<ARRAY<{group}>>)),
      (whole, part) -> aggregate(slice({spans}, cast(part * 256 + 1 AS int), 256),
        named_struct('end', whole.end, 'own', whole.own, 'out', cast(array() AS ARRAY<{group}>)),
        (acc, x) -> CASE WHEN x.start < acc.end THEN named_struct('end', greatest(acc.end, x.end), 'own', array_append(acc.own, x), 'out', acc.out)
          ELSE named_struct('end', x.end, 'own', array(x), 'out', array_append(acc.out, acc.own)) END,
        acc -> named_struct('end', acc.end, 'own', acc.own, 'out', array_append(whole.out, acc.out))),
      whole -> array_append(whole.out, array(whole.own))))"""
    ranked = "array_sort(transform(own, s -> named_struct('score', -s.score, 'chars', s.start - s.end, 'start', s.start, 'span', s)))"
    best = f"""aggregate({ranked}, cast(array() AS {group}),
      (held, x) -> CASE WHEN exists(held, y -> x.span.start < y.end AND y.start < x.span.end) THEN held ELSE array_append(held, x.span) END)"""
    return f"array_sort(flatten(transform({runs}, own -> {best})))"


def replaced(text: str, spans: str, pieces: str, by: str) -> str:
    """text with `by`, an expression over a span v, in place of the disjoint sorted spans; pieces is the text in parts of PIECE characters."""

    def part(a: str, b: str) -> str:
        first, last = f"cast({a} div {PIECE} AS int)", f"cast(({b} - 1) div {PIECE} AS int)"
        within = f"substring({pieces}[{first}], cast({a} % {PIECE} + 1 AS int), cast({b} - {a} AS int))"
        over = f"concat(substring({pieces}[{first}], cast({a} % {PIECE} + 1 AS int)), array_join(slice({pieces}, {first} + 2, {last} - {first} - 1), ''), left({pieces}[{last}], cast(({b} - 1) % {PIECE} + 1 AS int)))"
        return f"CASE WHEN {b} <= {a} THEN '' WHEN {first} = {last} THEN {within} ELSE {over} END"

    before = f"CASE WHEN i = 0 THEN 0L ELSE {spans}[i - 1].end END"
    kept = f"transform({spans}, (v, i) -> concat(transform(array({before}), p -> {part('p', 'v.start')})[0], {by}))"
    rest = f"transform(array({spans}[size({spans}) - 1].end), p -> {part('p', f'cast(length({text}) AS bigint)')})[0]"
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE concat(array_join({kept}, ''), {rest}) END"


def in_pieces(text: str, spans: str) -> Column:
    return F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def spans(df: DataFrame, model: dict | None = None) -> DataFrame:
    """df, which has text, with base and added, arrays of SPAN; added ones touch neither base spans nor each other."""
    model = model or train(df.sparkSession)
    needs = {"email": F.col("text").contains("@"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.lit(True), "phone": F.col("text").contains("+")}
    df = with_base(df, "text", "base", needs)
    df = df.withColumn("sorted", F.array_sort("base")).withColumn("cover", F.expr(swept("sorted", UNITED))).drop("sorted")
    df = df.withColumn("pieces", in_pieces("text", "cover"))
    df = df.withColumn("masked", F.expr(replaced("text", "cover", "pieces", f"repeat('{MASK}', cast(v.end - v.start AS int))"))).drop("pieces")
    df = with_base(df, "masked", "again", {k: (F.size("cover") > 0) & F.col("masked").rlike(r"[0-9]|@") for k in KINDS})
    for name in GENERATORS:
        df = with_located(df, name, "masked", GENERATORS[name], F.col("masked").rlike(HINTS[name]))
    tried = [f"transform({name}, c -> named_struct('start', c.start, 'end', c.end, 'm', c.m, 'b', c.b, 'a', c.a, 'k', '{kind}'))" for name, kinds in PROPOSED.items() for kind in kinds]
    df = df.withColumn("tried", F.expr(f"concat({', '.join(tried)})")).drop(*GENERATORS)
    df = df.withColumn("chosen", F.expr(f"array_sort(concat(again, {selected_sql('tried', model)}))")).drop("tried", "again", "masked", "cover")
    return df.withColumn("added", F.expr(accepted("chosen"))).drop("chosen")


def with_base(df: DataFrame, text: str, name: str, conditions: dict[str, Column]) -> DataFrame:
    """df with the matches of the base patterns in a text that pass their checks, kind by kind."""
    for kind in KINDS:
        df = with_located(df, f"base_{kind}", text, BASE[kind], conditions[kind])
        check = filled(CHECKS[kind], m="x.m")
        df = df.withColumn(f"base_{kind}", F.expr(f"transform(filter(base_{kind}, x -> {check}), x -> named_struct('start', x.start, 'end', x.end, 'kind', '{kind}', 'score', 2D))"))
    return df.withColumn(name, F.concat(*(f"base_{k}" for k in KINDS))).drop(*(f"base_{k}" for k in KINDS))


def with_located(df: DataFrame, name: str, text: str, pattern: str, condition: Column) -> DataFrame:
    """df with an array of (m, start, end, b, a) of the pattern's matches; texts that fail the condition have none."""
    searched = F.when(condition, F.col(text)).otherwise("")
    df = df.withColumns({"matches": F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)), "around": F.split(searched, pattern, -1)})
    return df.withColumn(name, F.expr(LOCATED)).drop("matches", "around")


def selected_sql(tried: str, model: dict) -> str:
    """Proposals (start, end, m, b, a, k) as SPAN with their score, those over their kind's threshold only."""
    features = ", ".join(f"'f{i}', {filled(f, m='c.m', b='c.b', a='c.a', k='c.k')}" for i, f in enumerate(FEATURES))
    scored = f"transform(transform({tried}, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.k, {features})), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'score', {model['score']}))"
    least = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in model["thresholds"].items()) + " END"
    return f"filter({scored}, s -> s.score >= {least})"


def joined(spans_sql: str) -> str:
    """kind:start:end by kind as listed, then start."""
    parts = [f"transform(array_sort(transform(filter({spans_sql}, s -> s.kind = '{kind}'), s -> named_struct('start', s.start, 'end', s.end))), s -> concat('{kind}:', s.start, ':', s.end))" for kind in KINDS]
    return f"array_join(concat({', '.join(parts)}), ',')"


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans, n_added."""
    df = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), model)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in KINDS]
    return df.select("doc_id", *counts, F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined("concat(base, added)")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with <KIND> in place of every span that find() lists; base spans that overlap are one of the first's kind. Null texts stay null."""
    # The documents as one column, so that none of theirs can clash with the names here.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    df = spans(docs.select(whole, F.coalesce("text", F.lit("")).alias("text")), model)
    df = df.withColumn("sorted", F.array_sort(F.concat("base", "added"))).withColumn("cover", F.expr(swept("sorted", UNITED)))
    df = df.withColumn("pieces", in_pieces("text", "cover"))
    clean = F.when(F.col("document.text").isNotNull(), F.expr(replaced("text", "cover", "pieces", "concat('<', upper(v.kind), '>')")))
    return df.withColumn("clean", clean).select(*(F.col("clean").alias(c) if c == "text" else F.col("document").getField(c).alias(c) for c in docs.columns))
