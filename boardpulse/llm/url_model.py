"""URL filter: rules first, else logistic regression on hashed character n-grams.

Everything is DataFrame expressions. Host and path are cut out of the URL; a rule fits a
host and its subdomains if the path starts with the rule's, the longest rule wins. Where
none fits, a linear score decides: the sum of the weights of the hashed 3- to 5-grams of
host and path over the root of their number. The weights come from a small labelled URL
table by batch gradient descent in the dual: every weight vector met on the way is a sum
of training rows, so one number per training row is iterated over their Gram matrix, all
inside one row. The table is bounded by ``MOST_TRAINING`` rows and the weights by
``BUCKETS`` numbers, which are attached to the URLs as one array. No shuffle of URLs.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule
and is scored like any text; repeated rows are judged each; an empty table gives no rows;
without usable training rows the model allows everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
MOST_TRAINING = 400
SIZES = (3, 4, 5)

# Labelled URLs: 1 is to be blocked. Written for this library; the hosts are invented.
TRAINING: tuple[tuple[str, int], ...] = tuple(
    [(f"https://{host}/{path}", 1) for host, path in (
        ("casino-bonus.example", "slots/free-spins"), ("bet365win.example", "live/odds"), ("poker-jackpot.example", "casino/roulette"),
        ("cheap-pills.example", "viagra/buy-now"), ("xxx-tube.example", "porn/video/123"), ("adult-dating.example", "sex/cams"),
        ("free-porn.example", "xxx/gallery"), ("crack-keygen.example", "download/warez.exe"), ("torrent-movies.example", "free/download.torrent"),
        ("payday-loan.example", "instant/cash-now"), ("replica-watches.example", "cheap/rolex"), ("win-prize.example", "claim/free-gift"),
        ("login-verify-account.example", "secure/update/password"), ("bitcoin-doubler.example", "invest/profit"), ("hot-girls.example", "nude/webcam"),
        ("spam-clicks.example", "popunder/adserver"), ("lottery-winner.example", "jackpot/claim"), ("pharmacy-online.example", "pills/no-prescription"),
        ("escort-service.example", "girls/adult"), ("malware-host.example", "payload/setup.exe"),
    )]
    + [(f"https://{host}/{path}", 0) for host, path in (
        ("www.university.example", "research/papers"), ("en.encyclopedia.example", "wiki/History"), ("docs.library.example", "api/reference.html"),
        ("blog.garden.example", "2023/05/roses"), ("news.city.example", "politics/article/88"), ("museum.example", "exhibitions/modern"),
        ("www.weather.example", "forecast/week"), ("recipes.example", "soup/lentil"), ("school.example", "en/courses"), ("m.sports.example", "football/results"),
        ("health.agency.example", "guidelines/vaccination"), ("forum.code.example", "questions/4412?page=2"), ("travel.example", "fr/paris/12033"),
        ("science.example", "de/artikel/5531.html"), ("www.government.example", "es/leyes/771"), ("books.example", "catalog/30122"),
        ("blog.people.example.com", "en/4120"), ("m.reader.example.net", "de/19733.html"), ("www.theatre.example.org", "fr/8021/"),
        ("stories.example.com", "es/30551?page=2&ref=x"), ("m.nature.example.com", "en/27719#top"), ("notes.example.net", "en/612"),
        ("www.trains.example.net", "de/7004?utm_source=feed"), ("blog.letters.example.org", "en/45390.html"), ("cities.example.com", "fr/990/"),
        ("m.history.example.org", "es/1203"), ("teachers.example.net", "en/33871?page=2"), ("www.answers.example.com", "de/58112"),
        ("shop.tools.example", "hammer/steel"), ("music.example", "albums/jazz"), ("maps.example", "en/43211#top"), ("journal.example", "en/issue/7?utm_source=feed"),
    )]
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path, both empty without ``://``; only A-Z are lowered."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(F.regexp_replace(rest, r"\A[^/?#]*", ""), r"\A[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule text and verdict of the longest fitting rule; null if none fits.

    A rule is (host, path, verdict); of equally long rules the one that blocks wins.
    """
    order = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r[2] != "block", r[0]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(order):
        fits_host = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = fits_host & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def buckets_of(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of ``^host path$``, with repeats."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))
    grams = [
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))),
            lambda i, size=size: F.pmod(F.xxhash64(F.substring(text, i, F.lit(size)), F.lit(size)), F.lit(BUCKETS)).cast("int"),
        )
        for size in SIZES
    ]
    return F.concat(*grams)


def training_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRAINING), "url string, label int")


def fit_urls(training: DataFrame, steps: int = 100, rate: float = 0.5, decay: float = 0.001) -> DataFrame:
    """One row: ``weights``, an array of ``BUCKETS`` doubles, and ``bias``.

    ``training`` has url and label (1 blocks); at most ``MOST_TRAINING`` distinct rows are used.
    """
    host, path = host_and_path(F.col("url"))
    usable = training.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).dropDuplicates(["url", "label"])
    rows = (
        usable.orderBy(F.xxhash64("url"), "url", "label")
        .limit(MOST_TRAINING)
        .select(F.struct("url", "label").alias("key"), (F.col("label") * 1.0).cast("double").alias("y"), buckets_of(host, path).alias("grams"))
    )
    pieces = rows.select("key", F.explode("grams").alias("bucket"), (1 / F.sqrt(F.size("grams"))).alias("unit"))
    # Bucket -1 is the bias: a feature of value 1 in every row, so that any two rows meet.
    values = (
        pieces.groupBy("key", "bucket")
        .agg(F.sum("unit").alias("value"))
        .unionByName(rows.select("key", F.lit(-1).alias("bucket"), F.lit(1.0).alias("value")))
    )
    left, right = values.alias("l"), values.alias("r")
    gram = (
        left.join(right, F.col("l.bucket") == F.col("r.bucket"))
        .groupBy(F.col("l.key").alias("key"), F.col("r.key").alias("other"))
        .agg(F.sum(F.col("l.value") * F.col("r.value")).alias("dot"))
    )
    lines = gram.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("other", "dot"))).alias("line"))
    table = lines.join(rows.select("key", "y"), "key").agg(F.array_sort(F.collect_list(F.struct("key", "y", "line"))).alias("table"))
    table = table.select(
        F.transform("table", lambda r: r["key"]).alias("keys"),
        F.transform("table", lambda r: r["y"]).alias("y"),
        F.transform("table", lambda r: F.transform(r["line"], lambda o: o["dot"])).alias("matrix"),
    )

    def step(alpha: Column, _: Column) -> Column:
        def update(line: Column, i: Column) -> Column:
            score = F.aggregate(F.zip_with(line, alpha, lambda k, a: k * a), F.lit(0.0), lambda s, v: s + v)
            return F.get(alpha, i) * (1 - rate * decay) + rate * (F.get(F.col("y"), i) - 1 / (1 + F.exp(-score)))

        return F.transform(F.col("matrix"), update)

    zeros = F.transform("y", lambda _: F.lit(0.0))
    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zeros, step)
    alphas = table.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), alpha.alias("alpha"))))
    weights = alphas.join(values, "key").groupBy("bucket").agg(F.sum(F.col("alpha") * F.col("value")).alias("weight"))
    packed = weights.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("by_bucket"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("by_bucket", b), F.lit(0.0))
    )
    return packed.select(dense.alias("weights"), F.coalesce(F.try_element_at("by_bucket", F.lit(-1)), F.lit(-1.0)).alias("bias"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    training: DataFrame,
    threshold: float = 0.5,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """Per row: id, host, path, rule, verdict and the model's probability of a block."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select("id", host.alias("host"), path.alias("path"))
    # One row of BUCKETS numbers, collected as such: its size does not depend on the URLs.
    model = fit_urls(training).first()
    weights = F.split(F.lit(",".join(map(repr, model["weights"]))), ",").cast("array<double>")  # folded to one constant
    bias = float(model["bias"])
    grams = buckets_of(F.col("host"), F.col("path"))
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(weights, b))
    scored = cut.withColumn("grams", grams).withColumn("score", 1 / (1 + F.exp(-(total / F.sqrt(F.size("grams")) + bias))))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_column), "host", "path", rule["rule"].alias("rule"), verdict.alias("verdict"), "score")
