"""URL filters: fixed rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Suffixes of two labels under which names are registered (fixed values; a parameter of `reputations`).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A driver-side rule list becomes one expression, so it is bounded.
MOST_RULES = 2000
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *LETTERS)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. A rule is ("allow" or "block", host and path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit one expression")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def suffix_of(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The last label, or the last two where they are a known suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    return F.when(F.size(F.split(suffix, r"\.")) == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(groups: DataFrame) -> Column:
    """Prior observations that the spread of groups (n, k, and mean m above them) speaks for, by moments of the beta-binomial; 1 to 1000."""
    over = F.try_divide(F.sum(F.expr("(k - n * m) * (k - n * m) / (m * (1 - m)) - n")), F.sum(F.expr("n * (n - 1)")))
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.lit(1.0), F.when(over > 0, over)) - 1, F.lit(1000.0))))


BOUND = "a / (a + b) - {d} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"


def levels(outcomes: DataFrame, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> dict[str, DataFrame]:
    """The posteriors (a, b of a beta distribution) that labelled outcomes (host, bad: boolean) lead to, by level.

    host: (host, suffix, domain, n, k, a, b) of hosts with outcomes. domain:
    (suffix, domain, a, b) and suffix: (suffix, a, b), for what is new below it: a
    host of the domain, a domain of the suffix.
    """
    counts = pick(outcomes, host="host", bad="bad").where("host is not null and bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.count_if("bad").cast("double").alias("k"))
    # a row for each host, which every level reads several times
    counts = Scratch(outcomes.sparkSession, "reputation").store(counts, "hosts")
    hosts = counts.withColumn("suffix", suffix_of(F.col("host"), two_labels)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    above = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)).alias("m"))  # one row
    new, out = "s * m as a", "s * (1 - m) as b"
    found = {}
    for level, below, key, name in ((suffixes, None, [], ""), (domains, suffixes, ["suffix"], "suffix"), (hosts, domains, ["suffix", "domain"], "domain")):
        # `above` holds the means that the level's groups are shrunk to
        level = level.join(above, key) if key else level.crossJoin(above)
        strength = level.agg(_strength(level).alias("s"))  # one row
        if key:
            found[name] = above.crossJoin(strength).selectExpr(*key, new, out)
        level = level.crossJoin(strength)
        if name == "domain":
            found["host"] = level.selectExpr("host", "suffix", "domain", "n", "k", "k + s * m as a", "n - k + s * (1 - m) as b")
        else:
            above = level.selectExpr("suffix", *(["domain"] if name == "suffix" else []), "(k + s * m) / (n + s) as m")
    return found


def reputations(outcomes: DataFrame, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES, deviations: float = 1.0) -> DataFrame:
    """What labelled outcomes (host, bad: boolean) say of each host: (host, n, k, bad_rate, bad_bound).

    The share of bad pages of a suffix is shrunk to that of all pages, that of a
    registered domain to its suffix, that of a host to its domain. Each prior is
    a beta distribution whose strength comes from the spread at its level. The
    bound is the posterior mean less `deviations` standard deviations. Outcomes
    are summed before they are shuffled, so a frequent host costs a row for each
    task. Null hosts or outcomes say nothing.
    """
    return levels(outcomes, two_labels)["host"].selectExpr("host", "cast(n as bigint) n", "cast(k as bigint) k", "a / (a + b) as bad_rate", f"{BOUND.format(d=deviations)} as bad_bound")


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None, most_bad: float = 0.5, deviations: float = 1.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for each page: (page_id, host, path, rule, verdict).

    The longest fitting rule decides. A page that no rule fits is blocked where
    the `bad_bound` of its host is over `most_bad`: that is, only where the share
    of bad pages is surely high. A host without outcomes is judged by the bound
    for a new host of its registered domain, without those by that for a new
    domain of its suffix; where the suffix has none either it is allowed.
    `outcomes` (host, bad) are labelled pages; without them, the rules' own
    verdicts on the pages they fit are the labels.

    Null urls and urls without `://` have an empty host and path, and no
    reputation: they are allowed. Repeated rows and null ids stay. Other columns
    are ignored; the page's content is never read. Only hosts, domains and
    suffixes that are judged otherwise than those above them are joined to pages.
    """
    rows = pick(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        outcomes = rows.where("fit is not null and host != ''").select("host", (F.col("fit.verdict") == "block").alias("bad"))
    of = {name: df.withColumn("bad", F.expr(BOUND.format(d=deviations)) > most_bad) for name, df in levels(outcomes).items()}
    suffix, none = of["suffix"], F.lit(False)
    domain = of["domain"].join(suffix.select("suffix", F.col("bad").alias("above")), "suffix")
    host = of["host"].join(domain.select("suffix", "domain", F.col("bad").alias("above")), ["suffix", "domain"])
    told = [suffix.where("bad").select(F.col("suffix").alias("s1"), F.col("bad").alias("b1")), domain.where("bad != above").select(F.col("suffix").alias("s2"), F.col("domain").alias("d2"), F.col("bad").alias("b2")), host.where("bad != above").select(F.col("host").alias("h3"), F.col("bad").alias("b3"))]
    rows = rows.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    met = rows.join(told[0], F.col("suffix") == F.col("s1"), "left").join(told[1], (F.col("suffix") == F.col("s2")) & (F.col("domain") == F.col("d2")), "left").join(told[2], F.col("host") == F.col("h3"), "left")
    free = F.when((F.col("host") != "") & F.coalesce("b3", "b2", "b1", none), "block").otherwise("allow")
    return met.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", free).alias("verdict"))


def judge_sql(rules: list[tuple[str, str]], most_bad: float = 0.5, deviations: float = 1.0, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> str:
    """The same over the view `pages`, for DuckDB."""
    rule_rows = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', {k})" for k, (v, r) in enumerate(sorted(rules, key=lambda r: (len(r[1]), r[1]))))
    two = ", ".join(f"'{x}'" for x in two_labels)
    strength = "least(1000.0, greatest(1.0, coalesce(1.0 / nullif(greatest(coalesce(sum((k - n*m)*(k - n*m)/(m*(1-m)) - n) / nullif(sum(n*(n-1)), 0), 0), 0), 0) - 1, 1000.0)))"
    return f"""
    with rules(verdict, rule, name, start, place) as (values {rule_rows}),
    urls as (select page_id, coalesce(url, '') as url from pages),
    rows0 as (select row_number() over () as rid, page_id,
        case when contains(url, '://') then translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{LETTERS[0]}', '{LETTERS[1]}') else '' end as host,
        case when contains(url, '://') then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end as path from urls),
    fits as (select rid, max_by(verdict, place) as verdict, max_by(rule, place) as rule from rows0, rules
        where (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by rid),
    judged as (select r.*, f.verdict, f.rule from rows0 r left join fits f using (rid)),
    counts as (select host, count(*)::double as n, count(*) filter (verdict = 'block')::double as k from judged where verdict is not null and host != '' group by host),
    parts as (select *, string_split(host, '.') as p from (select distinct host from judged)),
    suffixed as (select host, p, case when len(p) >= 2 and p[-2] || '.' || p[-1] in ({two}) then p[-2] || '.' || p[-1] else p[-1] end as suffix from parts),
    named as (select host, suffix, array_to_string(p[-(len(string_split(suffix, '.')) + 1):], '.') as domain from suffixed),
    hosts as (select * from named join counts using (host)),
    domains as (select suffix, domain, sum(n) as n, sum(k) as k from hosts group by all),
    suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
    l0 as (select *, (select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) from suffixes) as m from suffixes),
    s0 as (select {strength} as s from l0),
    l1 as (select d.*, (l0.k + s * l0.m) / (l0.n + s) as m from domains d join l0 using (suffix), s0),
    s1 as (select {strength} as s from l1),
    l2 as (select h.*, (l1.k + s * l1.m) / (l1.n + s) as m from hosts h join l1 using (suffix, domain), s1),
    s2 as (select {strength} as s from l2),
    -- what is known of a host, or of something new in its domain or in its suffix
    post as (select host, 0 as far, k + s * m as a, n - k + s * (1 - m) as b from l2, s2
        union all select host, 1, s2.s * (l1.k + s1.s * l1.m) / (l1.n + s1.s), s2.s * (1 - (l1.k + s1.s * l1.m) / (l1.n + s1.s)) from named join l1 using (suffix, domain), s1, s2
        union all select host, 2, s1.s * (l0.k + s0.s * l0.m) / (l0.n + s0.s), s1.s * (1 - (l0.k + s0.s * l0.m) / (l0.n + s0.s)) from named join l0 using (suffix), s0, s1),
    nearest as (select * from post where host != '' qualify row_number() over (partition by host order by far) = 1),
    bad as (select host from nearest where a/(a+b) - {deviations} * sqrt(a*b / ((a+b)*(a+b)*(a+b+1))) > {most_bad})
    select page_id, host, path, rule, coalesce(verdict, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from judged"""
