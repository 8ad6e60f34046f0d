"""Command line: predict, train, trainsvr, ism, explain, deltasvm, to-deltasvm,
score-variants, import."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import center_crop, letters
from .functions.tables import Kernel
from .operators import effects, loci
from .operators.deltasvm import DeltaSVM
from .operators.explain import explain
from .operators.train import train_svc, train_svr
from .sources import models
from .sources.text import read_fasta, read_labels, read_loci

CROP = 300


def sequences(spark: SparkSession, path: str, args, length: int | None) -> DataFrame:
    """id, name, seq from FASTA, or from loci where a genome is given; cropped to one length
    unless --variable-length."""
    if args.genome:
        genome = read_fasta(spark, args.genome).select(F.split("name", r"\s+")[0].alias("chrom"), "seq")
        rows = loci.extract(read_loci(spark, path).withColumn("id", F.monotonically_increasing_id()), genome, args.length or length or CROP).filter("kept")
        return rows.select("id", "name", "seq")
    rows = read_fasta(spark, path).select("id", "name", letters(F.col("seq"), args.allow_other_bases).alias("seq"))
    if args.variable_length or not (args.length or length):
        return rows
    n = args.length or length
    short = [r["name"] for r in rows.filter(F.length("seq") < n).limit(5).collect()]
    if short:
        raise SystemExit(f"shorter than {n}: {', '.join(short)} (see --length and --variable-length)")
    return rows.select("id", "name", center_crop(F.col("seq"), n).alias("seq"))


def model_length(model) -> int | None:
    sizes = [r[0] for r in model.sv.select(F.length("seq")).distinct().limit(2).collect()] if hasattr(model, "sv") else []
    return sizes[0] if len(sizes) == 1 else None


def write_tsv(rows: DataFrame, path: str | None) -> None:
    out = open(path, "w") if path and path != "-" else sys.stdout
    out.write("name\tscore\n")
    for r in rows.orderBy("id").select("name", "score").toLocalIterator():
        out.write(f"{r['name']}\t{r['score']:.6f}\n")
    if out is not sys.stdout:
        out.close()


def kernel_of(args) -> Kernel:
    return Kernel(args.t, args.l, args.k, args.d, args.gamma, args.M, args.H, not args.no_rc)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe", description=__doc__)
    commands = top.add_subparsers(dest="command")

    def command(name: str, *flags: tuple[tuple[str, ...], dict], inputs: bool = True, kernel: bool = False):
        p = commands.add_parser(name)
        for names, options in flags:
            p.add_argument(*names, **options)
        p.add_argument("-v", "--verbose", action="store_true")
        if inputs:
            p.add_argument("--genome")
            p.add_argument("--length", type=int)
            p.add_argument("--variable-length", action="store_true")
            p.add_argument("--allow-other-bases", action="store_true")
        if kernel:
            p.add_argument("-t", default="2")
            for flag, kind, default in (("-l", int, 11), ("-k", int, 7), ("-d", int, 3), ("--gamma", float, 1.0), ("-M", int, 50), ("-H", float, 50.0)):
                p.add_argument(flag, type=kind, default=default)
            p.add_argument("--no-rc", action="store_true")
            p.add_argument("-C", type=float, default=1.0)
            p.add_argument("--solver", default="auto")
            p.add_argument("--cache-size", type=float, default=4.0, help="GB of kernel matrix the driver may hold")

    need = {"required": True}
    m, i, o = (("-m", "--model"), need), (("-i", "--input"), need), (("-o", "--output"), {})
    out = (("-o", "--output"), need)
    command("predict", m, i, o, (("--batch-size",), {"type": int, "default": 100, "help": "kept for compatibility; partitions decide"}))
    command("train", (("-p", "--positive"), need), (("-n", "--negative"), need), out, (("-w", "--pos-weight"), {"type": float, "default": 1.0}), kernel=True)
    command("trainsvr", i, (("--labels",), need), out, (("--epsilon",), {"type": float, "default": 0.1}), kernel=True)
    command("ism", m, i, out)
    command("explain", m, i, out, (("-s", "--sequences-output"), need))
    command("deltasvm", (("-w", "--weights"), need), i, o, (("-l",), {"type": int, "default": 11}), (("--no-rc",), {"action": "store_true"}))
    command("to-deltasvm", m, out, (("--query-norm",), {"action": "store_true"}), inputs=False)
    command("score-variants", m, (("--ref",), need), (("--alt",), need), o, (("--method",), {"default": "kernel", "choices": ["kernel", "gkmexplain"]}))
    command(
        "import", i, out, (("-f", "--format"), {"required": True, "choices": ["lsgkm", "classic", "r_gkmsvm"]}), (("--svseq",), {}), (("-l",), {"type": int, "default": 10}),
        (("-k",), {"type": int, "default": 6}), (("-d",), {"type": int, "default": 3}), (("-t",), {"type": int, "default": 1}), (("--no-rc",), {"action": "store_true"}), inputs=False,
    )
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        top.print_help()
        return 1
    spark = spark or SparkSession.builder.appName("helixframe").getOrCreate()
    named = lambda rows, seqs: rows.join(seqs.select("id", "name"), "id")
    if args.command in ("predict", "ism", "explain", "score-variants", "to-deltasvm"):
        model = models.load_model(spark, args.model)
    if args.command == "predict":
        seqs = sequences(spark, args.input, args, model_length(model))
        write_tsv(named(model.score(seqs), seqs), args.output)
    elif args.command == "train":
        got = [sequences(spark, p, args, CROP) for p in (args.positive, args.negative)]
        models.save_model(train_svc(*got, kernel_of(args), args.C, args.pos_weight, args.solver, max_gram_gb=args.cache_size), args.output)
    elif args.command == "trainsvr":
        seqs = sequences(spark, args.input, args, CROP).join(read_labels(spark, args.labels), "id")
        models.save_model(train_svr(seqs, kernel_of(args), args.C, args.epsilon, args.solver, max_gram_gb=args.cache_size), args.output)
    elif args.command == "ism":
        seqs = sequences(spark, args.input, args, model_length(model))
        models.export_npz(effects.ism(model, seqs), seqs, args.output)
    elif args.command == "explain":
        seqs = sequences(spark, args.input, args, model_length(model))
        models.export_npz_pair(explain(model, seqs, "hypothetical"), seqs, args.output, args.sequences_output)
    elif args.command == "deltasvm":
        linear = models.load_deltasvm(spark, args.weights, args.l, False if args.no_rc else None)
        seqs = sequences(spark, args.input, args, None)
        write_tsv(named(linear.score(seqs), seqs), args.output)
    elif args.command == "to-deltasvm":
        models.write_deltasvm(model.to_deltasvm(args.query_norm), args.output)
    elif args.command == "score-variants":
        n = model_length(model) if not isinstance(model, DeltaSVM) else None
        ref, alt = (sequences(spark, p, args, n) for p in (args.ref, args.alt))
        write_tsv(named(model.score_variants(ref, alt, *([] if isinstance(model, DeltaSVM) else [args.method])), ref), args.output)
    else:
        if args.format == "lsgkm":
            model = models.load_lsgkm(spark, args.input)
        else:
            if not args.svseq:
                raise SystemExit("--svseq is needed for this format")
            model = models.load_classic(spark, args.input, args.svseq, args.l, args.k, args.d, args.t, not args.no_rc)
        models.save_model(model, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
