"""Commands: embed, generate, route."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from horosphere.sources.shared import release

log = logging.getLogger(__name__)


def utc(t: datetime) -> str:
    """As text.utc() writes it."""
    return f"{t:%Y/%m/%d} {t.hour}:{t:%M} UTC"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="horosphere")
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("embed", help="edge list to coordinates")
    e.add_argument("edges")
    e.add_argument("-o", "--output", default=None)
    e.add_argument("-b", "--beta", type=float)
    e.add_argument("-d", "--dimension", type=int, default=1)
    e.add_argument("-s", "--seed", type=int, default=1)
    for flag, name, text in (("-c", "clean", "write raw coordinates, too"), ("-f", "fast", "no refinement"), ("-k", "no-kappas", "no refit of kappas"), ("-p", "joint", "refit beta and kappas"), ("-e", "only-kappas", "kappas only"), ("-v", "validate", "write validation tables"), ("-q", "quiet", "no log"), ("-a", "screen", "log to the screen")):
        e.add_argument(flag, f"--{name}", action="store_true", help=text)
    e.add_argument("-r", "--refine", help="coordinates to start from")
    g = sub.add_parser("generate", help="hidden variables to a graph")
    g.add_argument("hidden")
    g.add_argument("-o", "--output", default=None)
    g.add_argument("-b", "--beta", type=float, required=True)
    g.add_argument("-m", "--mu", type=float)
    g.add_argument("-d", "--dimension", type=int, default=1)
    g.add_argument("-s", "--seed", type=int, default=1)
    for flag, name, text in (("-n", "names", "the first column is a name"), ("-t", "positions", "positions are given"), ("-a", "native", "a coordinate file of this package"), ("-v", "vertices", "write coordinates, too")):
        g.add_argument(flag, f"--{name}", action="store_true", help=text)
    r = sub.add_parser("route", help="greedy routing")
    r.add_argument("dimension", type=int)
    r.add_argument("coordinates")
    r.add_argument("edges")
    r.add_argument("modified", type=int, choices=(0, 1))
    r.add_argument("runs", type=int, nargs="?")
    return top


def start_log(path: str | None, screen: bool) -> list[logging.Handler]:
    """Handlers of the package's log: a file, or the screen, or none."""
    top = logging.getLogger("horosphere")
    top.setLevel(logging.INFO)
    handlers: list[logging.Handler] = [logging.StreamHandler()] if screen else [logging.FileHandler(path, "w")] if path else []
    for h in handlers:
        h.setFormatter(logging.Formatter("%(message)s"))
        top.addHandler(h)
    return handlers


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a, own = parser().parse_args(argv), spark is None
    spark = spark or SparkSession.builder.appName("horosphere").getOrCreate()
    handlers = []
    if a.command == "embed" and not a.quiet:
        root = a.output or a.edges.rsplit(".", 1)[0]
        handlers = start_log(f"{root}.inf_log" if "://" not in root else None, a.screen)
    try:
        return run(a, spark)
    finally:
        for h in handlers:
            logging.getLogger("horosphere").removeHandler(h)
            h.close()
        if own:
            release(spark)


def embed(edgelist_filename: str, output_name: str = "", inf_coord: str = "", fast_mode: bool = False, screen_mode: bool = False, post_kappa: bool = True, quiet_mode: bool = False, validation_mode: bool = False, clean_mode: bool = False, seed: int = -1, beta: float = -1, dimension: int = 1, spark: SparkSession | None = None) -> int:
    """The command embed as a function; a negative seed or beta means none is given."""
    argv = ["embed", edgelist_filename, "-d", str(dimension)]
    for value, flag in ((output_name, "-o"), (inf_coord, "-r"), (str(seed) if seed >= 0 else "", "-s"), (str(beta) if beta > 0 else "", "-b")):
        argv += [flag, value] if value else []
    for on, flag in ((fast_mode, "-f"), (screen_mode, "-a"), (not post_kappa, "-k"), (quiet_mode, "-q"), (validation_mode, "-v"), (clean_mode, "-c")):
        argv += [flag] if on else []
    return main(argv, spark)


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    from horosphere.operators import embed, generate, graph, routing, validate
    from horosphere.operators.infer import Params
    from horosphere.sources import text

    if a.command == "generate":
        out = a.output or a.hidden.rsplit(".", 1)[0]
        got = generate.generate(text.read_hidden(spark, a.hidden, a.dimension, a.names, a.positions, a.native), a.beta, a.dimension, a.mu, a.seed)
        text.write_edges(got.edges, got.vertices, f"{out}.edge")
        if a.vertices:
            text.write_table(text.by_name(got.vertices), f"{out}.gen_coord", ["name", "kappa", *(["theta", "hyp_rad"] if a.dimension == 1 else ["hyp_rad", "pos"]), "real_deg", "exp_deg"], f"- beta: {a.beta}\n- mu: {got.params.mu}")
        return 0
    named = text.read_edges(spark, a.edges)
    vertices = graph.dictionary(named)
    edges = graph.encoded(named, vertices)
    if a.command == "route":
        where = text.read_coordinates(spark, a.coordinates, a.dimension).join(vertices, "name")
        runs = routing.sample_runs(where, a.runs or 10 * where.count())
        got = routing.route(edges, where, runs, a.dimension, bool(a.modified))
        routing.summary(got, routing.shortest_paths(edges, runs)).toPandas().to_csv(sys.stdout, index=False)
        return 0
    began, out = datetime.now(UTC), a.output or a.edges.rsplit(".", 1)[0]
    log.info("Embedding started at %s", utc(began))
    config = embed.EmbedConfig(a.dimension, a.beta, a.fast, not a.no_kappas, a.joint, a.only_kappas, a.seed)
    start = None
    if a.refine:
        p = text.read_parameters(spark, a.refine)
        old = text.read_coordinates(spark, a.refine, a.dimension).join(vertices, "name").drop("hyp_rad", "name")
        n, m = vertices.count(), edges.count()
        start = old, Params(a.dimension, p["beta"], p["mu"], n, 2 * m / n)
    try:
        got = embed.embed(edges, config, start)
    except graph.MultipleComponentsError as e:
        text.write_edges(e.giant, vertices, f"{out}_GC.edge")
        return e.exit_code
    ended = datetime.now(UTC)
    log.info("Ended at %s", utc(ended))
    about = {"Embedding started at": utc(began), "Ended at": utc(ended), "Elapsed time": f"{(ended - began).total_seconds():.2f} seconds", "Edgelist file": a.edges}
    named_out = got.coordinates.join(vertices, "vid")
    if a.only_kappas:
        text.write_table(named_out.orderBy("vid"), f"{out}.kappas", ["kappa"])
        return 13
    text.write_coordinates(named_out, f"{out}.inf_coord", a.dimension, got.params.beta, got.params.mu, about=about, options={k.upper(): v for k, v in vars(a).items()})
    if a.clean:
        text.write_coordinates(named_out, f"{out}.inf_coord_raw", a.dimension, got.params.beta, got.params.mu, raw=True)
    if a.validate:
        tables = validate.validate(got.coordinates, edges, got.params, a.seed)
        for name, ext in (("connection", "inf_pconn"), ("ensemble_classes", "inf_vstat"), ("observed_classes", "obs_vstat")):
            text.write_table(tables[name].orderBy(F.col(tables[name].columns[0])), f"{out}.{ext}", header="")
        text.write_table(text.by_name(tables["vertex_properties"].join(vertices, "vid").drop("vid")), f"{out}.inf_vprop", header="")
        if a.dimension == 1:
            text.write_table(embed.theta_density(got.coordinates).orderBy("bin"), f"{out}.inf_theta_density", ["theta", "inf_density", "th_density"], "")
    return 0


if __name__ == "__main__":
    sys.exit(main())
