"""What a change reaches: seeds, blast radius, coverage, metrics and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import module_root
from .graph import live
from .numbers import identified, numbered
from .upsert import cut


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in a fixed order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def match_seeds(seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, seed, qualified_name, ...): symbols whose qualified name ends with the seed.

    A suffix join as an equi-join: each symbol gives its suffixes of the lengths that occur among
    the repository's seeds (a few tens).
    """
    wanted = seeds.select("repo_id", "seed").distinct().withColumn("_len", F.length("seed"))
    lengths = wanted.groupBy("repo_id").agg(F.collect_set("_len").alias("_lens"))
    ends = symbols.join(lengths, "repo_id").withColumn("_len", F.explode("_lens")).filter(F.length("qualified_name") >= F.col("_len")).withColumn("seed", F.right("qualified_name", F.col("_len"))).drop("_lens", "_len")
    return ends.join(wanted.drop("_len"), ["repo_id", "seed"])


def who_calls(symbols: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo_id, seed, caller, file_path, is_test): direct callers by exact name of live targets."""
    target = live(symbols).select("repo_id", F.col("name").alias("seed"), F.col("qualified_name").alias("dst")).join(seeds.select("repo_id", "seed").distinct(), ["repo_id", "seed"])
    callers = symbols.select("repo_id", F.col("qualified_name").alias("src"), F.col("name").alias("caller"), "file_path", "is_test")
    return target.join(edges, ["repo_id", "dst"]).join(callers, ["repo_id", "src"]).select("repo_id", "seed", "caller", "file_path", "is_test").distinct()


def in_all_repos(seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, seed): the seeds, in each repository that has a symbol whose qualified name ends with them."""
    one = F.lit(0).alias("repo_id")
    return match_seeds(seeds.select(one, "seed"), symbols.select(one, "qualified_name", F.col("repo_id").alias("home"))).select(F.col("home").alias("repo_id"), "seed").distinct()


def direct_callers(wanted: DataFrame, back: DataFrame, own: DataFrame, limit: int) -> DataFrame:
    """(id, row): the first `limit` rows of each wanted node's (id) callers; Spark cuts them off before it shuffles."""
    edges = back.join(wanted, back["dst"] == wanted["id"], "left_semi").select("dst", "src")
    rows = edges.join(own.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "row").distinct()
    return first_n(rows, ["id"], ["row"], limit)


def caller_lists(start: DataFrame, back: DataFrame, own: DataFrame, max_depth: int, limit: int) -> DataFrame:
    """(id, row, depth): for each node of start (id), and those that its list is made of, the first `limit` rows
    of its callers by (depth, row), at their least depth.

    back: edges (dst, src) of node ids; own: (id, row), the rows that a node stands for.  A node's list is made of
    its callers' lists, which are cut off at `limit` too; that loses nothing, as what stands before a row in a
    caller's list stands before it here as well.  So a hub with a million callers is `limit` rows after the first
    round, which Spark cuts off before it shuffles, and is not joined again: its list is full.
    """
    need = wanted = start.select("id").distinct()
    for _ in range(max_depth - 1):
        need = cut(back.join(need, back["dst"] == need["id"], "left_semi").select(F.col("src").alias("id")).distinct())
        wanted = wanted.unionByName(need)
    wanted = wanted.distinct()
    back = cut(back.join(wanted, back["dst"] == wanted["id"], "left_semi").select("dst", "src"))
    new = cut(direct_callers(wanted, back, own, limit))
    lists = new.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        sizes = cut(lists.groupBy(F.col("id").alias("dst")).agg(F.count("*").alias("n")))
        # a list that isn't full holds all rows of lower depth: what is new comes from the callers' rows of the round before
        rest = back.join(sizes, "dst", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < limit)
        rows = rest.join(new.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "row").agg(F.max("n").alias("n"))
        rows = rows.join(lists.select("id", "row"), ["id", "row"], "left_anti")
        place = F.row_number().over(Window.partitionBy("id").orderBy("row"))
        new = cut(rows.withColumn("_rank", place).filter(F.col("_rank") <= limit).filter(F.col("_rank") + F.col("n") <= limit).select("id", "row"))
        lists = lists.unionByName(new.withColumn("depth", F.lit(depth)))
    return lists


def radius_numbers(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int = 3, limit: int = 200, scope: str = "repo") -> tuple[DataFrame, DataFrame]:
    """The blast radius in numbers: (repo_id, seed, row, depth), and (row, repo_id, name, file, kind) in order of name, file, kind.

    With scope "all" neither has a repo_id.
    """
    max_depth, home = min(10, max(1, max_depth)), ["repo_id"] * (scope == "repo")
    known = live(symbols).select("repo_id", F.col("qualified_name").alias("node"), "name", F.col("file_path").alias("file"), F.col("type").alias("kind"))
    rows = numbered(known.select(*home, "name", "file", "kind"), [*home, "name", "file", "kind"], "row")
    found = seeds if scope == "repo" else in_all_repos(seeds, symbols)
    start = match_seeds(found, live(symbols)).select("repo_id", "seed", F.col("qualified_name").alias("node"))
    calls = cut(edges.select("repo_id", "src", "dst"))
    ends = [calls.select("repo_id", F.col(c).alias("node")) for c in ("src", "dst")]
    nodes = identified(known.select("repo_id", "node").unionByName(ends[0]).unionByName(ends[1]), "id")
    # equal also where a name is null, as the rows are distinct with their nulls
    same = [known[c].eqNullSafe(rows[c]) for c in (*home, "name", "file", "kind")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    own = known.join(rows, on).select(known["repo_id"], "node", "row").join(nodes, ["repo_id", "node"]).select("id", "row").distinct()
    back = calls
    for c in ("src", "dst"):
        back = back.join(nodes.select("repo_id", F.col("node").alias(c), F.col("id").alias(f"_{c}")), ["repo_id", c])
    back = cut(back.select(F.col("_dst").alias("dst"), F.col("_src").alias("src")).distinct())
    start = cut(start.join(nodes, ["repo_id", "node"]).select(*home, "seed", "id").distinct())
    own, keys = cut(own), [*home, "seed"]
    # a seed whose direct callers are `limit` rows has its list: what is deeper comes after them, and is not looked for
    near = direct_callers(start.select("id").distinct(), back, own, limit)
    direct = cut(first_n(start.join(near, "id").select(*keys, "row").distinct(), keys, ["row"], limit))
    full = direct.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= limit).select(*keys)
    rest = cut(start.join(full, keys, "left_anti"))
    done = direct.join(full, keys, "left_semi").select(*keys, "row", F.lit(1).alias("depth"))
    lists = caller_lists(rest, back, own, max_depth, limit)
    merged = rest.join(lists, "id").groupBy(*keys, "row").agg(F.min("depth").alias("depth"))
    return done.unionByName(first_n(merged, keys, ["depth", "row"], limit).select(*keys, "row", "depth")), rows


def blast_radius(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int = 3, limit: int = 200, scope: str = "repo") -> DataFrame:
    """(repo_id, seed, name, file, kind, depth): live callers within max_depth hops of the live symbols that a
    seed names, at their least depth, the first `limit` of each seed by depth and name.

    scope: "repo", or "all": seeds (seed) name symbols of any repository, and the rows of a seed
    have no repo_id.  Deleted symbols are followed, not reported.  See caller_lists().
    """
    found, rows = radius_numbers(seeds, symbols, edges, max_depth, limit, scope)
    return found.join(rows.select("row", "name", "file", "kind"), "row").select(*["repo_id"] * (scope == "repo"), "seed", "name", "file", "kind", "depth")


def _first_distinct(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n distinct rows of each key; Spark leaves out later ones before it shuffles, as they have a rank in each task too."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", place).filter(F.col("_rank") <= n).drop("_rank").distinct()


def trails(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int, limit: int, fields: list[str]) -> DataFrame:
    """(repo_id, seed, *fields, depth): the first `limit` rows of each seed, by depth and fields, on trails of callers that use no edge twice.

    fields: ["path"], the names on a trail to a live caller; or name, file and kind of the live callers.  The rows of a
    depth are cut off at `limit` where they are made, and a seed grows no further once it has `limit` rows, as deeper
    ones come after them; so the trails of a hub are not written.  Without paths, trails that end in one node and use
    the same edges are one.
    """
    keys, paths = ["repo_id", "seed"], fields == ["path"]
    ends = symbols.select("repo_id", F.col("qualified_name").alias("src"), "name", F.col("file_path").alias("file"), F.col("type").alias("kind"), (~F.coalesce("deleted", F.lit(False))).alias("_live"))
    calls = identified(edges.select("repo_id", F.col("dst").alias("node"), "src"), "edge")
    backward = cut(calls.join(ends, ["repo_id", "src"]))
    at = match_seeds(seeds, live(symbols)).select(*keys, F.col("qualified_name").alias("node"), F.array(*["name"] * paths).cast("array<string>").alias("names"), F.array().cast("array<bigint>").alias("used"))
    at = cut(at.dropDuplicates([*keys, "node"]))

    def grown(at: DataFrame) -> DataFrame:
        step = at.join(backward, ["repo_id", "node"]).filter(~F.array_contains("used", F.col("edge")))
        used = F.array_append("used", F.col("edge"))
        path = F.array_append("names", F.col("name")) if paths else F.col("names")
        return step.select(*keys, F.col("src").alias("node"), path.alias("names"), (used if paths else F.array_sort(used)).alias("used"), "name", "file", "kind", "_live")

    out: DataFrame | None = None
    for depth in range(1, min(10, max(1, max_depth)) + 1):
        if depth > 1:  # at: the trails of the depth before, of seeds that lack rows
            full = cut(out.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= limit).select(*keys))
            at = grown(at.join(full, keys, "left_anti")).select(*keys, "node", "names", "used")
            at = cut(at if paths else at.distinct())
        new = cut(_first_distinct(grown(at).filter("_live").select(*keys, *(["names"] if paths else fields)), keys, ["names"] if paths else fields, limit)).withColumn("depth", F.lit(depth))
        out = new if out is None else out.unionByName(new)
    return first_n(out.withColumnRenamed("names", "path") if paths else out, keys, ["depth", *fields], limit)


def blast_radius_all_depths(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int = 3, limit: int = 200) -> DataFrame:
    """As blast_radius, with a row for each depth at which a trail reaches a caller."""
    return trails(seeds, symbols, edges, max_depth, limit, ["name", "file", "kind"])


def impact_paths(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int = 2, limit: int = 50) -> DataFrame:
    """(repo_id, seed, path, depth): call chains from a seed to its live callers."""
    return trails(seeds, symbols, edges, max_depth, limit, ["path"])


def test_coverage(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 20, scope: str = "repo") -> DataFrame:
    """(repo_id, seed, test_file, test_name): direct test callers of the live symbols that a seed names; scope as in blast_radius."""
    if scope == "all":
        rows = test_coverage(in_all_repos(seeds, symbols), symbols, edges, limit).select("seed", "test_file", "test_name").distinct()
        return first_n(rows, ["seed"], ["test_file", "test_name"], limit)
    start = match_seeds(seeds, live(symbols)).select("repo_id", "seed", F.col("qualified_name").alias("dst")).distinct()
    tests = symbols.filter("is_test").select("repo_id", F.col("qualified_name").alias("src"), F.col("file_path").alias("test_file"), F.col("name").alias("test_name"))
    rows = start.join(edges, ["repo_id", "dst"]).join(tests, ["repo_id", "src"]).select("repo_id", "seed", "test_file", "test_name").distinct()
    return first_n(rows, ["repo_id", "seed"], ["test_file", "test_name"], limit).filter("test_file <> ''")


def commit_profiles(own: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, seeds, ordinals, roots) of each commit, and (profile, seeds): a number for each list of seeds that occurs.

    own: (key, seed, ordinal, root).  seeds stand in order of their first ordinal.  What a change reaches depends on that
    list alone, so it is found once for each profile, however many commits have it.
    """
    firsts = own.select(*key, "seed", "ordinal", "root").repartition(*key).groupBy(*key, "seed").agg(F.min("ordinal").cast("long").alias("ordinal"), F.collect_set("root").alias("roots"))
    lists = firsts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "seed"))).alias("x"), F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"))
    lists = cut(lists.select(*key, F.col("x.seed").alias("seeds"), F.col("x.ordinal").alias("ordinals"), "roots"))
    return lists, identified(lists.select("seeds"), "profile")


#: Pairs of a profile and a seed that one task puts together; each has up to `limit` rows of the radius.
PAIRS = 5_000


def dealt(profiles: DataFrame) -> tuple[int, int]:
    """(tasks, size): in how many parts profiles, and their commits, are dealt out by profile, and the longest list of seeds."""
    sums = profiles.agg(F.sum(F.size("seeds")), F.max(F.size("seeds"))).first()
    return max(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sums[0] or 0) // PAIRS), sums[1] or 0


def least_rows(radius: DataFrame, names: DataFrame) -> DataFrame:
    """(seed, label, depth, row): of each seed the first row of each label; radius: (seed, row, depth), names: (row, label)."""
    return radius.join(names, "row").groupBy("seed", "label").agg(F.min(F.struct("depth", "row")).alias("x")).select("seed", "label", "x.depth", "x.row")


def impacted_symbols(profiles: DataFrame, least: DataFrame, rows: int, tasks: int, longest: int) -> DataFrame:
    """(profile, row, depth, place): of each profile's radius rows the first of each label by (depth, place, row).

    profiles: (profile, seeds), written; least: as least_rows() gives it, rows below `rows`; tasks, longest: as dealt()
    gives them; place: the seed's place in its list.  The order is packed into one number, of which an aggregation keeps
    the least.  Profiles are dealt out before they get their rows, so where `least` is broadcast nothing but profiles is
    shuffled, and the rows of a profile stand in one task for whatever is gathered from them.
    """
    both = profiles.repartition(tasks, "profile").select("profile", F.posexplode("seeds").alias("place", "seed")).join(least, "seed")
    row_bits, place_bits = max(1, int(rows).bit_length()), int(longest).bit_length()
    if row_bits + place_bits + 4 > 63:  # too many for one number
        best = both.groupBy("profile", "label").agg(F.min(F.struct("depth", "place", "row")).alias("x"))
        return best.select("profile", "x.row", "x.depth", "x.place")
    packed = F.shiftleft(F.col("depth").cast("long"), row_bits + place_bits).bitwiseOR(F.shiftleft(F.col("place").cast("long"), row_bits)).bitwiseOR(F.col("row"))
    best = both.groupBy("profile", "label").agg(F.min(packed).alias("x"))
    low = lambda bits: F.lit((1 << bits) - 1)
    return best.select("profile", F.col("x").bitwiseAND(low(row_bits)).alias("row"), F.shiftright("x", row_bits + place_bits).cast("int").alias("depth"), F.shiftright("x", row_bits).bitwiseAND(low(place_bits)).cast("int").alias("place"))


def profile_tests(profiles: DataFrame, impacted: DataFrame, tests: DataFrame, tasks: int) -> DataFrame:
    """(profile, tests_to_run, tested): sorted distinct test files over seeds and impacted symbols; whether a seed has one.

    profiles: (profile, seeds); impacted: (profile, seed), dealt out in `tasks` parts; tests: (seed, tests), lists.
    """
    both = profiles.repartition(tasks, "profile").select("profile", F.explode("seeds").alias("seed")).join(tests, "seed").groupBy("profile").agg(F.array_distinct(F.flatten(F.collect_list("tests"))).alias("_own"))
    near = impacted.join(tests, "seed").select("profile", F.explode("tests").alias("test")).distinct().groupBy("profile").agg(F.collect_list("test").alias("_near"))
    none = F.array().cast("array<string>")
    out = both.join(near, "profile", "full")
    return out.select("profile", F.sort_array(F.array_union(F.coalesce("_own", none), F.coalesce("_near", none))).alias("tests_to_run"), F.col("_own").isNotNull().alias("tested"))


def profile_sizes(impacted: DataFrame) -> DataFrame:
    """(profile, _n, _depth, _roots) of impacted symbols (profile, depth, root): how many, the greatest depth, the module roots."""
    by_root = impacted.groupBy("profile", "root").agg(F.count("*").alias("_n"), F.max("depth").alias("_depth"))
    return by_root.groupBy("profile").agg(F.sum("_n").alias("_n"), F.max("_depth").alias("_depth"), F.collect_set("root").alias("_roots"))


def investigate(lists: DataFrame) -> DataFrame:
    """fan_out_count, max_depth_reached, cross_module and has_test_coverage of each commit, in place of what they are made of.

    lists: a commit's roots, as commit_profiles() gives them, with its profile's _n, _depth, _roots and tested, or nulls.
    """
    over = F.size(F.array_except("_roots", "roots")) > 0
    own = [c for c in lists.columns if c not in ("seeds", "ordinals", "roots", "_n", "_depth", "_roots", "tested")]
    return lists.select(*own, F.coalesce("_n", F.lit(0)).cast("long").alias("fan_out_count"), F.coalesce("_depth", F.lit(0)).alias("max_depth_reached"), F.coalesce(over & F.col("_roots").isNotNull(), F.lit(False)).alias("cross_module"), F.coalesce("tested", F.lit(False)).alias("has_test_coverage"))


def risk_reasons() -> Column:
    """Sentences on the metrics, in fixed order."""
    return F.filter(
        F.array(
            F.concat(F.col("fan_out_count").cast("string"), F.lit(" downstream symbol(s) impacted")),
            F.when(F.col("max_depth_reached") > 0, F.concat(F.lit("Impact reaches "), F.col("max_depth_reached").cast("string"), F.lit(" level(s) deep"))),
            F.when(F.col("cross_module"), F.lit("Change crosses module boundaries")),
            F.when(F.col("has_test_coverage"), F.lit("Test coverage found — risk partially mitigated")).otherwise(F.lit("No test coverage detected for changed symbols")),
        ),
        lambda x: x.isNotNull(),
    )


def risk_score(metrics: DataFrame, least_fan_out: int = 5) -> DataFrame:
    """Metrics with score, level and reasons; below least_fan_out impacted symbols 0, low and none."""
    score = F.greatest(F.lit(0), F.col("fan_out_count") * 2 + F.col("max_depth_reached") * 3 + F.col("cross_module").cast("int") * 5 - F.col("has_test_coverage").cast("int") * 4).cast("int")
    wide = F.col("fan_out_count") >= least_fan_out
    level = F.when(F.col("score") < 8, "low").when(F.col("score") <= 15, "medium").otherwise("high")
    return metrics.withColumn("score", F.when(wide, score).otherwise(0)).withColumn("level", F.when(wide, level).otherwise("low")).withColumn("reasons", F.when(wide, risk_reasons()).otherwise(F.array().cast("array<string>")))


def impacted_coverage_flags(impacted: DataFrame, gaps: DataFrame, limit: int = 7) -> DataFrame:
    """The first impacted symbols of each commit, whether each is covered, and how many more there are."""
    key = ["repo_id", "commit_id"]
    marked = impacted.withColumn("gap", F.concat_ws("::", "file", "name")).join(gaps.select(*key, "gap").distinct().withColumn("_bare", F.lit(True)), [*key, "gap"], "left")
    own = Window.partitionBy(*key)
    ranked = marked.withColumn("place", F.row_number().over(own.orderBy("depth", "ordinal", "name", "file"))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(own) - limit))
    return ranked.filter(F.col("place") <= limit).select(*key, "place", "name", "file", "depth", F.col("_bare").isNull().alias("covered"), "more")


def profile_coverage_flags(impacted: DataFrame, limit: int = 7) -> DataFrame:
    """impacted_coverage_flags of each profile, from (profile, depth, place, name, file, bare)."""
    own = Window.partitionBy("profile")
    some = first_n(impacted, ["profile"], ["depth", "place", "name", "file"], limit)
    sizes = impacted.groupBy("profile").agg(F.greatest(F.lit(0), F.count("*") - limit).alias("more"))
    return some.withColumn("place", F.row_number().over(own.orderBy("depth", "place", "name", "file"))).join(sizes, "profile").select("profile", "place", "name", "file", "depth", (~F.col("bare")).alias("covered"), "more")
