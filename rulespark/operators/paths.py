"""JSON paths over a column of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cursor import RuleError
from ..functions.jsonpath import column, columns, find, parse_path, parse_with_functions, source_with_functions
from ..functions.jsonvalue import dump, parse
from ..functions.outcome import over_documents
from ..functions.values import compile_chain, run_chain
from .validator import in_batches


def path_nodes(path: str, variant: Column) -> Column:
    """The nodes of a path as ARRAY<VARIANT>."""
    return columns(parse_path(path), variant)


def path_value(path: str, variant: Column) -> Column | None:
    """The node of a path of single fields and positions as VARIANT."""
    return column(parse_path(path), variant)


def json_path(df: DataFrame, json_col: str, path: str, out: str = "nodes", keep_order: bool = False) -> DataFrame:
    """df with the nodes of a path, as an array of JSON texts; bad JSON has none. Paths run in Columns, where an object's values come by
    key; keep_order=True runs them on trees, in the document's order. Functions after the path run on trees as well."""
    tree, calls = parse_with_functions(path)
    if keep_order or calls:
        return json_path_trees(df, json_col, path, out)
    none = F.array().cast("array<string>")

    def nodes(v: Column) -> Column:
        return F.when(v.isNull(), none).otherwise(F.coalesce(F.transform(columns(tree, v), lambda x: F.to_json(x)), none))

    return over_documents(df, json_col, nodes, {out: lambda x: x})


def json_path_trees(df: DataFrame, json_col: str, path: str, out: str = "nodes") -> DataFrame:
    """The same on parsed trees in Arrow batches, for any path: document order, repeated keys."""
    tree, calls = parse_with_functions(path)
    chain = compile_chain(calls)

    def run(text):
        try:
            doc = parse(text if text is not None else "")
            return ([dump(run_chain(chain, x)) for x in find(tree, doc, doc)],)
        except ValueError:
            return ([],)

    return in_batches(df, json_col, run, [(out, "array<string>")])


def explode_path(df: DataFrame, json_col: str, path: str, out: str = "node") -> DataFrame:
    """A row for each node."""
    return json_path(df, json_col, path, "__nodes").withColumn(out, F.explode("__nodes")).drop("__nodes")


def printed_paths(df: DataFrame, path_col: str, out: str = "printed") -> DataFrame:
    """df, whose rows hold paths as texts, with each in one form, which reads back to the same path; null for what is no path."""

    def run(text):
        try:
            return (source_with_functions(*parse_with_functions(text)) if text is not None else None,)
        except RuleError:
            return (None,)

    return in_batches(df, path_col, run, [(out, "string")])
