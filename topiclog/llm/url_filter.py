"""URL filters: explicit host and path rules first, association rules for the rest; built-in functions only.

FP-growth mines which combinations of URL tokens the blocked pages share. Rules are pruned by support and
confidence, and a rule goes when a part of its tokens alone is as sure. A page fits a rule if it has all of its
tokens; an inverted index finds the rules by their rarest token, so a token of most pages leads to no rule that a rarer one finds.

Two things keep mining from growing with the number of subsets of a template: tokens that occur in exactly the same labelled pages are
one item (whatever holds for one of them holds for all), and an antecedent has `longest` items at most.
Numbers are no tokens: they name single pages, and a rule about them would only repeat the labels.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclog.llm.common import TMP, lower_ascii
from topiclog.llm.components import cut

#: Explicit rules: verdict, and host with path. A host stands for its subdomains too.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: Most bytes of the index of rules that are broadcast; beyond them the same join is a shuffle.
BROADCAST = 64 << 20
#: FP-growth has no bound on the length of sets. Where a basket has more items than this, pattern growth with such a bound finds the same sets.
WIDE = 14


def host(url: Column) -> Column:
    """What follows the first "://", up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(own_host: Column, own_path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null; of equally long rules the last by name."""
    found = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((own_host == name) | F.endswith(own_host, F.lit(f".{name}"))) & F.startswith(own_path, F.lit(slash + rest))
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    kind = "struct<size:int,rule:string,verdict:string>"
    return F.array_max(F.array(*found)) if found else F.lit(None).cast(kind)


def tokens(own_host: Column, own_path: Column) -> Column:
    """The distinct tokens of an URL: parts of its host (h:) and of its path (p:) that are not numbers, in lower case."""
    part = lambda text, mark: F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x.rlike(r"[^\p{N}]")), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(part(own_host, "h:"), part(own_path, "p:")))


def _alike(contents: DataFrame, least: int) -> DataFrame:
    """token, item and members of every token of at least `least` blocked pages: tokens that lie in the same pages are one item, named by the first.

    The pages of a token are compared by their number and two 64-bit sums of hashes; contents: items, n, n_block.
    """
    sums = [F.bit_xor(F.xxhash64("items", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    each = contents.select("items", "n", "n_block", F.explode("items").alias("token"))
    found = each.groupBy("token").agg(F.sum("n_block").alias("b"), F.sum("n").alias("n"), *sums).where(F.col("b") >= least)
    groups = found.groupBy("n", "h0", "h1").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select(F.explode("members").alias("token"), F.get("members", F.lit(0)).alias("item"), "members")


def _frequent(baskets: DataFrame, least: int, longest: int) -> DataFrame:
    """set (sorted) and n_block of the sets of at most `longest` items that at least `least` baskets (items) have."""
    size = baskets.agg(F.count("*"), F.max(F.size("items"))).first()
    share = (least - 0.5) / max(size[0], least)
    if (size[1] or 0) <= WIDE:
        found = FPGrowth(itemsCol="items", minSupport=share).fit(baskets).freqItemsets.select(F.array_sort("items").alias("set"), F.col("freq").alias("n_block"))
        return found.where(F.size("set") <= longest)
    ordered = baskets.select(F.transform(F.array_sort("items"), lambda x: F.array(x)).alias("sequence"))
    found = PrefixSpan(minSupport=share, maxPatternLength=longest).findFrequentSequentialPatterns(ordered)
    return found.select(F.flatten("sequence").alias("set"), F.col("freq").alias("n_block"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, least_pages: int = 20, longest: int = 7) -> DataFrame:
    """antecedent, alike and confidence of the rules that lead to a block; labelled has items (tokens) and block (boolean).

    Every labelled row counts; rows whose block is null are not labelled. A rule's support is the number of blocked pages that have
    its tokens: a share of min_support of all labelled pages, and least_pages, are the least. An antecedent has `longest` items at most, each
    named by its first token; alike has all tokens of each item, any of which will do. No labels, or too few blocked pages, give no rules.
    """
    none = labelled.sparkSession.createDataFrame([], "antecedent array<string>, alike array<array<string>>, confidence double")
    known = labelled.where("block is not null").select(F.array_sort("items").alias("items"), F.col("block").cast("long").alias("b"))
    contents = cut(known.groupBy("items").agg(F.count("*").alias("n"), F.sum("b").alias("n_block")))
    total = contents.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_block"), F.lit(0))).first()
    least = max(least_pages, -int(-min_support * total[0] // 1))
    if total[1] < least:
        return none
    items = cut(_alike(contents, least))
    merged = contents.select("items", "n", "n_block", F.explode("items").alias("token")).join(items.select("token", "item"), "token")
    merged = cut(merged.groupBy("items", "n", "n_block").agg(F.array_sort(F.collect_set("item")).alias("set")).select(F.col("set").alias("items"), "n", "n_block"))
    blocked = merged.where("n_block > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), "n_block"))).select("items")
    if blocked.isEmpty():
        return none
    sets = cut(_frequent(blocked, least, longest))
    one = sets.select("set", F.transform("set", lambda x: F.array(x)).alias("alike"))
    every = _fitting(merged, one).groupBy("set").agg(F.sum("n").alias("n"))
    sure = cut(sets.join(every, "set").select(F.col("set").alias("antecedent"), (F.col("n_block") / F.col("n")).alias("confidence")).where(F.col("confidence") >= min_confidence))
    # a rule is pruned if leaving out one of its items keeps the confidence
    less = sure.select("antecedent", "confidence", F.explode("antecedent").alias("out")).select("antecedent", "confidence", F.array_remove("antecedent", F.col("out")).alias("part"))
    parts = sure.select(F.col("antecedent").alias("part"), F.col("confidence").alias("as_sure"))
    pruned = less.join(parts, "part").where("as_sure >= confidence").select("antecedent").distinct()
    kept = sure.join(pruned, "antecedent", "left_anti")
    named = kept.select("antecedent", "confidence", F.posexplode("antecedent").alias("k", "item")).join(items.where("token = item").select("item", "members"), "item")
    whole = named.groupBy("antecedent", "confidence").agg(F.array_sort(F.collect_list(F.struct("k", "members"))).alias("m"))
    return cut(whole.select("antecedent", F.col("m.members").alias("alike"), "confidence"))


def _fitting(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of pages (items, other columns) with each rule (set, alike) that they fit: a token of each of its items.

    A rule is in the index under the tokens of one item only, that with the fewest pages. The index is broadcast up to a measured size.
    """
    known = rules.select("set", "alike", F.posexplode("alike").alias("k", "own")).select("set", "alike", "k", F.explode("own").alias("token"))
    wanted = known.select("token").distinct()
    wanted = F.broadcast(wanted) if (wanted.agg(F.sum(F.octet_length("token") + 24)).first()[0] or 0) <= BROADCAST else wanted
    often = pages.select(F.explode("items").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("pages"))
    cost = known.join(often, "token", "left").groupBy("set", "alike", "k").agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.collect_list("token").alias("own"))
    index = cut(cost.groupBy("set", "alike").agg(F.min_by("own", F.struct("pages", "k")).alias("own")).select("set", "alike", F.explode("own").alias("token")))
    text = lambda c: F.octet_length(F.array_join(c, " "))
    size = index.agg(F.sum(F.octet_length("token") + text(F.col("set")) + text(F.flatten("alike")) + 24 * (F.size("set") + F.size(F.flatten("alike")) + 4))).first()[0] or 0
    near = pages.select("*", F.explode("items").alias("token")).join(F.broadcast(index) if size <= BROADCAST else index, "token")
    whole = near.where(F.forall("alike", lambda own: F.arrays_overlap(own, F.col("items"))))
    return whole.drop("token", "alike").dropDuplicates()


def matched(pages: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """The distinct keys of the rows of pages (key columns and items) that fit at least one rule, by the inverted index. Null items are none."""
    return _fitting(pages, rules.select(F.col("antecedent").alias("set"), "alike")).select(*key).distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, min_support: float = 0.002, min_confidence: float = 0.6, least_pages: int = 20, longest: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    An explicit rule's verdict comes first; rows without one are blocked if a mined rule fits and allowed otherwise.
    labels has url and block (boolean; null: not labelled). A null url, or one without "://", has an empty host and path and
    no tokens, so it is allowed; rows that repeat get the same verdict each; a null page_id stays null, ids may be of any type; other columns are
    ignored; without labels nothing is mined. Ties between explicit rules of one length go to the last by name.
    """
    of = F.col("url")
    base = pages.select("page_id", host(of).alias("host"), path(of).alias("path"))
    base = base.withColumn(f"{TMP}rule", explicit(F.col("host"), F.col("path"), rules))
    mined = mine(labels.select(tokens(host(of), path(of)).alias("items"), "block"), min_support, min_confidence, least_pages, longest)
    chosen = F.col(f"{TMP}rule")
    verdict = F.coalesce(chosen["verdict"], F.lit("allow"))
    if not mined.isEmpty():
        # the key of a row is what its verdict depends on; not filtered, as a filter would copy the rule's expression
        key = [f"{TMP}host", f"{TMP}path"]
        hashes = [F.xxhash64("host", "path"), F.xxhash64("path", "host")]
        base = base.select("*", *(h.alias(k) for h, k in zip(hashes, key, strict=True)))
        open_rows = base.select(*key, F.when(chosen.isNull(), tokens(F.col("host"), F.col("path"))).alias("items"))
        bad = matched(open_rows, mined, key).withColumn(f"{TMP}bad", F.lit(True))
        base = base.join(bad, key, "left")
        verdict = F.coalesce(chosen["verdict"], F.when(F.col(f"{TMP}bad"), "block"), F.lit("allow"))
    return base.select("page_id", "host", "path", chosen["rule"].alias("rule"), verdict.alias("verdict"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and block of the pages whose document has labels: block if it is toxic or of low quality.

    The second part of a page's path starts with the number of the document that it was made from. Null urls, urls without such a
    number and labels without an id are ignored; a null mark counts as harmless; of several labels the worst counts.
    """
    number = F.regexp_extract(path(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("block"))
    own = pages.select("url", F.when(number != "", number.cast("long")).alias(f"{TMP}n"))
    return own.join(bad, own[f"{TMP}n"] == bad["doc_id"]).select("url", "block")
