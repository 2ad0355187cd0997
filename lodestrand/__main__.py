"""Command line: validate or repair sequence files."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .operators.hashing import duplicate_rows
from .options import Options, load_options, save_options
from .plans import reports, sinks
from .plans.events import Events
from .plans.validation import dedupe_by_hash_file, validate
from .sources.files import file_sizes, read_hash_file


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestrand", description=__doc__)
    p.add_argument("paths", nargs="+")
    p.add_argument("-o", "--output", help="folder for the outputs; without it the report is shown")
    p.add_argument("-p", "--parameters", help="XML file of options and rules")
    p.add_argument("-x", "--save-parameters", help="write the options to this XML file")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--depth", type=int, help="levels of folders below those given, with -r; all without it")
    p.add_argument("--hash-file", help="table of hashes: keep the first name of each sequence")
    flags = {"fix": "repair", "rename-duplicates": "rename duplicate names", "consolidate": "merge duplicate sequences", "ignore-il": "I and L alike", "remove-invalid-residues": "", "keep-same-name": "", "allow-asterisk": "", "allow-dash": "", "save-basic-hashes": "", "strict-eof": "", "add-missing-line-feed": "also write files that lack their last line end, with it", "normalize-line-ends": "also write the files with CRLF line ends", "stats-file": "add the report to the day's statistics file"}
    for name, text in flags.items():
        p.add_argument(f"--{name}", action="store_true", help=text)
    p.add_argument("--progress", action="store_true", help="tell how far the run is")
    p.add_argument("--skip-duplicate-names", action="store_true")
    p.add_argument("--skip-duplicate-sequences", action="store_true")
    a = p.parse_args(arguments)
    options = replace(Options(), check_duplicate_names=not a.skip_duplicate_names, check_duplicate_sequences=not a.skip_duplicate_sequences, save_hashes=a.fix, **{n.replace("-", "_"): getattr(a, n.replace("-", "_")) for n in flags})
    if a.parameters:
        options = load_options(a.parameters, options)
    if a.save_parameters:
        save_options(options, a.save_parameters)
    spark = SparkSession.builder.appName("lodestrand").getOrCreate()
    say = lambda *x: print(*x, file=sys.stderr)
    events = Events(status=say, warning=say, error=say, progress=lambda step, done, n: say(f"{step}: {done} of {n} tasks"), every=10.0) if a.progress else None
    if a.hash_file:
        run, unique, names, coverage = dedupe_by_hash_file(spark, a.paths, read_hash_file(spark, a.hash_file), options, a.recursive, a.depth)
        coverage.show()
        if a.output:
            reports.write_table(unique, "unique", f"{a.output}/unique")
            reports.write_table(names, "names", f"{a.output}/names")
    else:
        run = validate(spark, a.paths, replace(options, strict_eof=options.strict_eof or options.add_missing_line_feed), a.recursive, a.depth, events=events)
    sizes = file_sizes(spark, a.paths, a.recursive, a.depth)
    if not a.output:
        reports.report(run, sizes).show(1000, truncate=False)
        return
    if options.stats_file:
        sinks.append_stats_file(run, a.output, sizes)
    else:
        reports.report_lines(run, sizes=sizes).write.text(f"{a.output}/report")
    if options.normalize_line_ends:
        sinks.write_normalised_files(run, f"{a.output}/normalised")
    if options.add_missing_line_feed and run.ends is not None:
        reports.write_with_last_line_end(run, f"{a.output}/line-feed-added")
    if options.save_basic_hashes:
        sinks.write_table_files(run.hashes, "hashes", run.names, a.output)
    if run.options.fix:
        sinks.write_fixed_files(run, a.output)
        if options.save_hashes and not a.hash_file:
            sinks.write_table_files(run.unique, "unique", run.names, a.output)
            sinks.write_table_files(duplicate_rows(run.hashes), "duplicates", run.names, a.output)


if __name__ == "__main__":
    main()
