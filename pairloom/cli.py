"""Commands on files: ``python -m pairloom COMMAND ...``, also ``main([...], spark)`` from a program.

Inputs are paths that Spark reads; outputs are folders of part files with their header beside them (``--single``: one file with the
header inside). Options that are not listed are refused.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import conditions
from .operators import coverage, dedup, intervals, molecules, order, phase, rows, scaling, stats, walks
from .sources import sam, text
from .sources.header import Header, merge_headers, transfer
from .sources.text import PairsTable


DEDUP_COLUMNS = {"c1": "chrom1", "c2": "chrom2", "p1": "pos1", "p2": "pos2", "s1": "strand1", "s2": "strand2"}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairloom")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, inputs: str | None = "path", many: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if inputs:
            p.add_argument(inputs, nargs="+" if many else None)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--single", action="store_true")
        return p

    for name in ("parse", "parse2"):
        p = command(name)
        p.add_argument("-c", "--chroms-path", required=True)
        p.add_argument("--assembly")
        p.add_argument("--min-mapq", type=int, default=1)
        p.add_argument("--max-inter-align-gap", type=int, default=20)
        p.add_argument("--add-columns", default="")
        p.add_argument("--flip", action=argparse.BooleanOptionalAction, default=name == "parse")
        p.add_argument("--readid-transform", help="an expression in readID, such as readID[:-2] + '_x'")
        for flag in ("--drop-readid", "--drop-seq", "--drop-sam", "--add-pair-index"):
            p.add_argument(flag, action="store_true")
        p.add_argument("--output-stats")
        p.add_argument("--output-parsed-alignments")
    p = commands.choices["parse"]
    p.add_argument("--max-molecule-size", type=int, default=750)
    p.add_argument("--walks-policy", choices=walks.POLICIES, default="5unique")
    p.add_argument("--report-alignment-end", choices=("5", "3"), default="5")
    p = commands.choices["parse2"]
    p.add_argument("--report-position", choices=tuple(walks.POSITIONS), default="outer")
    p.add_argument("--report-orientation", choices=walks.ORIENTATIONS, default="pair")
    p.add_argument("--max-insert-size", type=int, default=500)
    p.add_argument("--dedup-max-mismatch", type=int, default=3)
    p.add_argument("--single-end", action="store_true")
    p.add_argument("--expand", action="store_true")
    p.add_argument("--max-expansion-depth", type=int)

    p = command("sort")
    for option, default in (("c1", "chrom1"), ("c2", "chrom2"), ("p1", "pos1"), ("p2", "pos2"), ("pt", "pair_type")):
        p.add_argument(f"--{option}", default=default)
    p.add_argument("--extra-col", action="append", default=[])
    p = command("merge", "paths", many=True)
    p.add_argument("--concatenate", action="store_true")
    p.add_argument("--keep-first-header", action="store_true")
    p = commands.add_parser("select")
    p.add_argument("condition")
    p.add_argument("path")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--single", action="store_true")
    p.add_argument("--output-rest")
    p.add_argument("--chrom-subset")
    p.add_argument("-t", "--type-cast", nargs=2, action="append", default=[])
    p.add_argument("-r", "--remove-columns", default="")
    p = command("dedup")
    p.add_argument("--output-dups")
    p.add_argument("--output-unmapped")
    p.add_argument("--output-stats")
    p.add_argument("--output-bytile-stats")
    p.add_argument("--max-mismatch", type=int, default=3)
    p.add_argument("--method", choices=("max", "sum"), default="max")
    p.add_argument("--rule", choices=("transitive", "greedy"), default="transitive")
    p.add_argument("--mark-dups", action="store_true")
    p.add_argument("--keep-parent-id", action="store_true")
    p.add_argument("--extra-col-pair", nargs=2, action="append", default=[])
    for option, default in DEDUP_COLUMNS.items():
        p.add_argument(f"--{option}", default=default)
    p.add_argument("--unmapped-chrom", default="!")
    p.add_argument("--yaml", action="store_true")
    p.add_argument("--filter", action="append", default=[], help="NAME:CONDITION")
    p = command("flip")
    p.add_argument("-c", "--chroms-path", required=True)
    command("markasdup")
    p = command("split")
    p.add_argument("--output-sam")
    p = command("restrict")
    p.add_argument("-f", "--frags", required=True)
    p = command("phase")
    p.add_argument("--phase-suffixes", nargs=2, required=True)
    p.add_argument("--tag-mode", choices=("XB", "XA"), default="XB")
    p.add_argument("--report-scores", action="store_true")
    p.add_argument("--clean-output", action="store_true")
    p = commands.add_parser("sample")
    p.add_argument("fraction", type=float)
    p.add_argument("path")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--single", action="store_true")
    p.add_argument("-s", "--seed", type=int, default=0)
    p = command("filterbycov")
    p.add_argument("--output-highcov")
    p.add_argument("--output-unmapped")
    p.add_argument("--max-cov", type=int, default=8)
    p.add_argument("--max-dist", type=int, default=500)
    p.add_argument("--method", choices=("max", "sum"), default="max")
    p.add_argument("--mark-multi", action="store_true")
    p.add_argument("--output-stats")
    p = command("stats", "paths", many=True)
    p.add_argument("--merge", action="store_true")
    p.add_argument("--yaml", action="store_true")
    p.add_argument("--with-chromsizes", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--n-dist-bins-decade", type=int, default=8)
    p.add_argument("--output-bytile-stats")
    p.add_argument("--filter", action="append", default=[], help="NAME:CONDITION")
    p = command("scaling")
    p.add_argument("--view")
    p.add_argument("--dist-range", nargs=2, type=int, default=(1, 10**9))
    p.add_argument("--n-dist-bins-decade", type=int, default=8)
    p = command("header")
    p.add_argument("action", choices=("generate", "transfer", "set-columns", "validate-columns"))
    p.add_argument("--reference-file")
    p.add_argument("--chroms-path")
    p.add_argument("--assembly")
    p.add_argument("--columns")
    return top


def _report(spark: SparkSession, content: str, path: str) -> None:
    spark.createDataFrame([(line,) for line in content.splitlines()], "value string").coalesce(1).write.mode("error").text(path)


def _table(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("error").csv(path, sep="\t", header=True)


class _Run:
    def __init__(self, spark: SparkSession, options: argparse.Namespace) -> None:
        self.spark, self.o = spark, options

    def read(self, path: str | None = None, **options) -> PairsTable:
        return text.read_pairs(self.spark, path or self.o.path, **options)

    def write(self, df: DataFrame, header: Header, path: str | None = None) -> None:
        header = header if not header.is_empty else Header.standard(columns=df.columns)
        header = header.with_columns(df.columns).add_program(self.o.command)
        text.write_pairs(PairsTable(df, header), path or self.o.output, single=getattr(self.o, "single", False))

    def parse(self) -> None:
        o = self.o
        records = sam.read_bam(self.spark, o.path) if o.path.endswith(".bam") else sam.read_sam(self.spark, o.path)
        sizes = text.read_chromsizes(self.spark, o.chroms_path)
        lines = [] if o.path.endswith(".bam") else sam.read_sam_header(self.spark, o.path)
        named = [f.split("SN:")[1].split("\t")[0] for f in lines if f.startswith("@SQ")]
        chroms = [c for c in text.chrom_order(sizes, named) if c != "!"]
        common = {k: getattr(o, k) for k in ("min_mapq", "max_inter_align_gap", "flip", "drop_readid", "drop_seq", "drop_sam", "add_pair_index")}
        common["add_columns"] = [c for c in o.add_columns.split(",") if c]
        common["readid"] = o.readid_transform
        if o.command == "parse":
            common |= {k: getattr(o, k) for k in ("max_molecule_size", "walks_policy", "report_alignment_end")}
        else:
            common |= {"mode": "parse2", "position": o.report_position, "orientation": o.report_orientation, "max_insert": o.max_insert_size, "slack": o.dedup_max_mismatch}
            common |= {"single_end": o.single_end, "expanded": o.expand, "depth": o.max_expansion_depth}
        df = molecules.parse(records, chroms, **common)
        self.write(df, Header.standard(sizes, o.assembly, df.columns).with_samheader(lines))
        if o.output_stats:
            _report(self.spark, text.render_stats(stats.nested(stats.long_table(df))), o.output_stats)
        if o.output_parsed_alignments:
            molecules.parsed_alignments(records, o.min_mapq).select("line").write.mode("error").text(o.output_parsed_alignments)

    parse2 = parse

    def sort(self) -> None:
        o, t = self.o, self.read(ordinal="order_")
        df = order.sort_pairs(t.df, o.c1, o.c2, o.p1, o.p2, o.pt, o.extra_col, ordinal="order_").drop("order_")
        header = t.header if not t.header.is_empty else Header.standard(columns=df.columns)
        self.write(df, header.mark_sorted())

    def merge(self) -> None:
        tables = [self.read(p) for p in self.o.paths]
        headers = [t.header for t in tables]
        header = headers[0] if self.o.keep_first_header else merge_headers(headers)
        self.write((order.concatenate if self.o.concatenate else order.merge)([t.df for t in tables]), header)

    def select(self) -> None:
        o, t = self.o, self.read()
        df, header = t.df, t.header
        kept, rest = conditions.split_by(df, o.condition, dict(o.type_cast))
        if o.chrom_subset:
            chroms = list(text.read_chromsizes(self.spark, o.chrom_subset))
            inside = F.coalesce(F.col("chrom1").isin(chroms) & F.col("chrom2").isin(chroms), F.lit(False))
            kept, rest, header = kept.where(inside), rest.unionByName(kept.where(~inside)), header.subset_chroms(chroms)
        drop = [c for c in o.remove_columns.split(",") if c]
        self.write(rows.remove_columns(kept, drop), header)
        if o.output_rest:
            self.write(rows.remove_columns(rest, drop), header, o.output_rest)

    def _routes(self, routed: DataFrame, header: Header, paths: dict[str, str | None]) -> None:
        text.write_routes(routed, (header if not header.is_empty else Header.standard(columns=routed.columns)).add_program(self.o.command), {k: v for k, v in paths.items() if v})

    def _statistics(self, trees: dict, path: str, yaml: bool) -> None:
        """The first tree as lines of key and value, or all of them as YAML."""
        _report(self.spark, text.render_yaml(trees) if yaml else text.render_stats(next(iter(trees.values()))), path)

    def dedup(self) -> None:
        o, t = self.o, self.read()
        own = {getattr(o, option): name for option, name in DEDUP_COLUMNS.items() if getattr(o, option) != name}
        if set(own.values()) & set(t.df.columns):
            raise SystemExit(f"the table has columns of these names besides the ones given: {sorted(set(own.values()) & set(t.df.columns))}")
        df = t.df.withColumnsRenamed(own)
        df = df.withColumns({c: F.col(c).try_cast("long") for c in ("pos1", "pos2")})
        extra = [tuple(e) for e in o.extra_col_pair]
        order_ = [c for c in dedup.ORDER if c in df.columns]
        out = dedup.deduplicate(df, o.max_mismatch, o.method, o.rule, extra, order_, o.unmapped_chrom)
        tiles = stats.bytile_duplicates(out.where("route = 'dups'")) if o.output_bytile_stats else None
        marked = dedup.marked(out, sam="sam1" in df.columns)
        final = (marked if o.mark_dups else out).withColumnsRenamed({v: k for k, v in own.items()})
        self._routes(final if o.keep_parent_id else final.drop("parent_readID"), t.header, {"nodups": o.output, "dups": o.output_dups, "unmapped": o.output_unmapped})
        if o.output_stats:
            filters = dict(f.split(":", 1) for f in o.filter)
            unmapped = {c: F.when(F.col(c) == o.unmapped_chrom, "!").otherwise(F.col(c)) for c in ("chrom1", "chrom2")}
            long = stats.long_table(marked.withColumns(unmapped), filters)
            self._statistics({n: stats.nested(long, n, tiles if n == stats.NO_FILTER else None) for n in [stats.NO_FILTER, *filters]}, o.output_stats, o.yaml)
        if tiles is not None:
            _table(tiles, o.output_bytile_stats)

    def flip(self) -> None:
        t = self.read()
        self.write(rows.flip(t.df, list(text.read_chromsizes(self.spark, self.o.chroms_path))), t.header)

    def markasdup(self) -> None:
        t = self.read()
        self.write(rows.mark_duplicates(t.df), t.header)

    def split(self) -> None:
        t = self.read()
        self.write(rows.split_pairs(t.df), t.header)
        if self.o.output_sam:
            head = self.spark.createDataFrame([(i, x) for i, x in enumerate(t.header.samheader)], "i long, line string")
            head.orderBy("i").select("line").coalesce(1).write.mode("error").text(f"{self.o.output_sam}/_header")
            rows.split_sam(t.df).select("line").write.mode("append").text(self.o.output_sam)

    def restrict(self) -> None:
        t = self.read()
        self.write(intervals.annotate_fragments(t.df, text.read_bed(self.spark, self.o.frags)), t.header)

    def phase(self) -> None:
        o, t = self.o, self.read()
        self.write(phase.phase(t.df, o.phase_suffixes, o.tag_mode, o.report_scores, o.clean_output), t.header)

    def sample(self) -> None:
        t = self.read()
        self.write(rows.sample(t.df, self.o.fraction, self.o.seed, t.df.columns), t.header)

    def filterbycov(self) -> None:
        o, t = self.o, self.read()
        routed = coverage.filter_by_coverage(t.df, o.max_cov, o.max_dist, o.method, mark_multi=o.mark_multi)
        self._routes(routed, t.header, {"low": o.output, "high": o.output_highcov, "unmapped": o.output_unmapped})
        if o.output_stats:
            self._statistics({stats.NO_FILTER: stats.nested(stats.long_table(routed.withColumn("pair_type", F.when(F.col("route") == "high", "DD").otherwise(F.col("pair_type")))))}, o.output_stats, False)

    def stats(self) -> None:
        o = self.o
        filters = dict(f.split(":", 1) for f in o.filter)
        tiles = None
        if o.merge:
            found = [text.read_stats(self.spark, p).where("key not like 'summary/%'").select(F.lit(stats.NO_FILTER).alias("filter"), "key", F.col("value").try_cast("long").alias("value")).where("value is not null") for p in o.paths]
            sizes = stats.merge_chromsizes([{r["key"].split("/", 1)[1]: r["value"] for r in t.where("key like 'chromsizes/%'").collect()} for t in found])
            long = stats.merge([t.where("key not like 'chromsizes/%'") for t in found])
        else:
            tables = [self.read(p) for p in o.paths]
            sizes = stats.merge_chromsizes([t.header.chromsizes for t in tables])
            edges = stats.distance_edges(o.n_dist_bins_decade)
            long = stats.merge([stats.long_table(t.df, filters, edges) for t in tables])
            if o.output_bytile_stats:
                dups = [t.df.where("pair_type = 'DD'") for t in tables]
                if any("parent_readID" not in d.columns for d in dups):
                    raise SystemExit("duplicates by tile need the column parent_readID")
                pairs = dups[0].select("readID", "parent_readID")
                for d in dups[1:]:
                    pairs = pairs.unionByName(d.select("readID", "parent_readID"))
                tiles = stats.bytile_duplicates(pairs)
                _table(tiles, o.output_bytile_stats)
        names = [stats.NO_FILTER, *filters]
        sizes = sizes if o.with_chromsizes else None
        trees = {n: stats.nested(long, n, tiles if n == stats.NO_FILTER else None, sizes) for n in (names if o.yaml or not filters else names[1:])}
        self._statistics(trees, o.output, o.yaml)

    def scaling(self) -> None:
        o, t = self.o, self.read()
        regions = text.read_regions(self.spark, o.view) if o.view else None
        sizes = None if o.view else t.header.chromsizes or None
        _table(scaling.scaling_table(t.df, regions=regions, chromsizes=sizes, edges=scaling.geometric_edges(*o.dist_range, o.n_dist_bins_decade)), o.output)

    def header(self) -> None:
        o, t = self.o, self.read()
        if o.action == "generate":
            sizes = text.read_chromsizes(self.spark, o.chroms_path) if o.chroms_path else None
            new = Header.standard(sizes, o.assembly, o.columns.split(",") if o.columns else t.df.columns)
        elif o.action == "transfer":
            new = transfer(t.header, text.read_header(self.spark, o.reference_file))
        elif o.action == "set-columns":
            new = t.header.with_columns(o.columns.split(","))
        else:
            new = t.header
            wanted = o.columns.split(",") if o.columns else new.columns
            first = text.without_headers(text.lines(self.spark, o.path), [o.path]).first()
            if first is not None and len(first["value"].split("\t")) != len(wanted):
                raise SystemExit(f"the rows have {len(first['value'].split(chr(9)))} fields, the header names {len(wanted)}")
        if len(new.columns) != len(t.df.columns):
            raise SystemExit("the numbers of columns differ")
        text.write_pairs(PairsTable(t.df.toDF(*new.columns), new), o.output, single=o.single)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    options = _parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("pairloom").getOrCreate()
    from . import ship

    ship(session)
    getattr(_Run(session, options), options.command.replace("-", "_"))()
