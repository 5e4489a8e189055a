"""Relations that all graph queries join with: definitions, imports, resolved names and real references.

Names are resolved for all sites at once. A site is a (file, name) pair, and a name in a file always resolves alike, so each pair is
resolved once however many calls it has; candidates are never multiplied with sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import import_symbol, import_tail, stem
from codeloom.schema import DEFINITION_KINDS, REFERENCE_KINDS
from codeloom.sources.tables import save


def definitions(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*DEFINITION_KINDS) & ~F.col("external"))


def imports(nodes: DataFrame) -> DataFrame:
    """(id, file_path, symbol, tail) of import nodes."""
    return nodes.where("kind = 'import'").select("id", "file_path", import_symbol(F.col("name")).alias("symbol"), import_tail(F.col("name")).alias("tail"))


def resolve_sites(sites: DataFrame, nodes: DataFrame, flags: tuple[str, ...] = ()) -> DataFrame:
    """(ref_file, name, def_id, branch) of distinct sites (ref_file, name); def_id is null if nothing has the name. flags: columns of sites
    to keep, true if they are in any row of a site.

    The only definition of that name; else the only one in the file; else the only one whose file the file imports the name from; else
    the first of all by (file, line, seq).
    """
    d = definitions(nodes).select("name", F.col("id").alias("def_id"), "file_path", F.coalesce("line_start", F.lit(0)).alias("line"), "seq")
    order = F.struct("file_path", "line", "seq", "def_id")
    by_name = d.groupBy("name").agg(F.count("*").alias("n"), F.min(order)["def_id"].alias("first"))
    same = d.groupBy("name", F.col("file_path").alias("ref_file")).agg(F.count("*").alias("n_same"), F.min("def_id").alias("same"))
    known = imports(nodes).where("symbol is not null").select(F.col("file_path").alias("ref_file"), F.col("symbol").alias("name"), "tail").distinct()
    confirmed = known.join(d.withColumn("tail", stem(F.col("file_path"))), ["name", "tail"]).groupBy("ref_file", "name").agg(F.count("*").alias("n_imported"), F.min("def_id").alias("imported"))
    # This leaves the sites placed for the joins by both; only that by name moves them again.
    s = sites.groupBy("ref_file", "name").agg(*(F.max(x).alias(x) for x in flags)) if flags else sites.select("ref_file", "name").distinct()
    joined = s.join(same, ["ref_file", "name"], "left").join(confirmed, ["ref_file", "name"], "left").join(by_name, "name", "left")
    branch = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "only").when(F.col("n_same") == 1, "same_file").when(F.col("n_imported") == 1, "imported").otherwise("first")
    return joined.withColumn("branch", branch).select("ref_file", "name", F.when(F.col("branch") == "same_file", F.col("same")).when(F.col("branch") == "imported", F.col("imported")).otherwise(F.col("first")).alias("def_id"), "branch", *flags)


def resolved_sites(nodes: DataFrame) -> DataFrame:
    """Sites of all calls and stubs."""
    refs = nodes.where((F.col("kind") == "call") | F.col("external"))
    return resolve_sites(refs.select(F.col("file_path").alias("ref_file"), "name"), nodes)


def links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, seq, name, ref_file, target_kind, target_external): references with their target, nulls if it is missing."""
    e = edges.where(F.col("kind").isin(*REFERENCE_KINDS)).select("source_id", "target_id", "kind", "seq")
    return e.join(nodes.select(F.col("id").alias("target_id"), "name", F.col("file_path").alias("ref_file"), F.col("kind").alias("target_kind"), F.col("external").alias("target_external")), "target_id", "left")


def reference_pairs(nodes: DataFrame, to: DataFrame, named: DataFrame, brought: DataFrame) -> DataFrame:
    """(node_id, referrer_id, calls, imports, inherits): a row for each pair, with the path of each kind of reference as a number, 0 for a,
    null without. nodes: all, or some; to: links to these; named: references_by_name to these; brought: all links of imports."""
    direct = to.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("referrer_id"), "kind", F.lit(0).alias("path"))
    by_name = named.select("node_id", "referrer_id", "kind", F.when(F.col("kind") == "calls", 1).otherwise(2).alias("path"))
    symbols = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("symbol"), stem(F.col("file_path")).alias("tail"))
    brought = brought.where("kind = 'imports' and target_kind = 'import'").select(F.col("source_id").alias("referrer_id"), import_symbol(F.col("name")).alias("symbol"), import_tail(F.col("name")).alias("tail"))
    brought = brought.where("symbol is not null").distinct().join(symbols, ["symbol", "tail"]).select("node_id", "referrer_id", F.lit("imports").alias("kind"), F.lit(3).alias("path"))
    least = [F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in REFERENCE_KINDS]
    return direct.unionByName(by_name).unionByName(brought).groupBy("node_id", "referrer_id").agg(*least)


def references_by_name(out: DataFrame) -> DataFrame:
    """(node_id, referrer_id, kind) of calls and stubs that resolve to a definition, which may repeat. out: resolved_out of these at least."""
    some = out.where("target_id <> resolved_id and (kind = 'calls' and target_kind = 'call' or kind = 'inherits' and target_external)")
    return some.select(F.col("resolved_id").alias("node_id"), F.col("source_id").alias("referrer_id"), "kind")


def references_to(near: DataFrame, nodes: DataFrame, links: DataFrame, sites: DataFrame) -> DataFrame:
    """(node_id, referrer_id, kind, path): real_refs to the ids in near (node_id), few of them. Only what may refer to these is moved.

    links: of all edges; sites: resolved_sites, if not more.
    """
    near = save(near.select("node_id").distinct(), "near")
    some = save(nodes.join(near.select(F.col("node_id").alias("id")), "id", "left_semi").select("id", "name", "file_path"), "near")
    at = save(sites.join(near.select(F.col("node_id").alias("def_id")), "def_id", "left_semi").select("ref_file", "name", "def_id"), "near")
    to = links.join(near.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    named = references_by_name(resolved_links(links.join(at.select("ref_file", "name"), ["ref_file", "name"], "left_semi"), at))
    symbols = some.select(F.col("name").alias("symbol")).distinct()
    brought = links.where("kind = 'imports'").withColumn("symbol", import_symbol(F.col("name"))).join(symbols, "symbol", "left_semi").drop("symbol")
    return refs_of_pairs(reference_pairs(some, to, named, brought))


def refs_of_pairs(pairs: DataFrame) -> DataFrame:
    """(node_id, referrer_id, kind, path) of reference_pairs."""
    each = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("path")) for k in REFERENCE_KINDS)), lambda x: x["path"].isNotNull())
    return pairs.select("node_id", "referrer_id", F.inline(each)).withColumn("path", F.substring(F.lit("abcd"), F.col("path") + 1, F.lit(1)))


def real_refs(nodes: DataFrame, edges: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Distinct (node_id, referrer_id, kind, path): who really refers to a node, and by which path it was found first.

    (a) edges straight to it; (b) calls of its name that resolve to it; (c) stubs of its name that resolve to it; (d) imports of its name
    from a module called like its file. Containment is no reference.
    """
    to = links(nodes, edges)
    return refs_of_pairs(reference_pairs(nodes, to, references_by_name(resolved_links(to, resolved_sites(nodes) if sites is None else sites)), to))


def resolved_links(to: DataFrame, sites: DataFrame) -> DataFrame:
    """resolved_out of links by sites that are made."""
    t = to.where("kind in ('calls', 'inherits') and target_kind is not null")
    return t.join(sites.select("ref_file", "name", "def_id"), ["ref_file", "name"], "left").select("source_id", "kind", "target_id", F.coalesce("def_id", "target_id").alias("resolved_id"), "target_kind", "target_external", "seq")


def resolved_out(nodes: DataFrame, edges: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(source_id, kind, target_id, resolved_id, target_kind, target_external, seq) of calls and inherits edges; what resolves to nothing
    stands for itself.

    Any target's name is resolved, whatever its kind.
    """
    to = links(nodes, edges).where("kind in ('calls', 'inherits') and target_kind is not null")
    return resolved_links(to, resolve_sites(to.select("ref_file", "name"), nodes) if sites is None else sites)


def file_imports(nodes: DataFrame) -> DataFrame:
    """Distinct (src_file, dst_file): a file imports a module called like another file."""
    files = nodes.where("kind = 'file'").select(F.col("file_path").alias("dst_file"), stem(F.col("file_path")).alias("tail")).distinct()
    wanted = imports(nodes).select(F.col("file_path").alias("src_file"), "tail").distinct()
    return wanted.join(files, "tail").where("src_file <> dst_file").select("src_file", "dst_file").distinct()
