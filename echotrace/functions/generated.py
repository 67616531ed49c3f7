"""Machine-written files, which a scan leaves out: by name, by a mark near the top, by a banner in the leading comments, or minified."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Endings of names that tools give their output.
GENERATED_ENDINGS = (
    ".pb.go .pb.gw.go _pb2.py _pb2_grpc.py _pb2.pyi .pb.cc .pb.h .pb.swift .pb.dart .pbenum.dart .pbgrpc.dart .pbjson.dart _gen.go .gen.go _string.go .generated.go "
    ".generated.ts .generated.tsx .generated.js .designer.cs .g.cs .g.i.cs .generated.cs .g.dart .freezed.dart .gr.dart .config.dart .min.js .min.css"
).split()
# Phrases that only tools write, anywhere in the first characters; and phrases that count at the start of a line of the banner.
STRONG_MARKS = ("code generated .*do not edit", "do not modify by hand", "@generated", "@autogenerated", "<auto-?generated")
BANNER_MARKS = (
    r"^(code generated|generated code|generated by|automatically generated|auto-?generated)\b", r"this (file|code) (is|was) (auto(matically)?[- ]?)?generated",
    "auto-?generated (file|code|by|from)",
)
# Lines with # that are code.
DIRECTIVES = ("#include", "#pragma", "#define", "#undef", "#if", "#else", "#elif", "#endif", "#import", "#error", "#line", "#[", "#![")
#: How much of a file is looked at for marks; what counts as a long line; how long lines are on average where they rule.
HEAD, LONG_LINE, LONG_AVERAGE = 4096, 2000, 500


def is_minified(text: Column) -> Column:
    """Long lines make up more than half of the text, and lines are long on average."""
    lines = F.split(text, "\n", -1)
    long = F.aggregate(lines, F.lit(0), lambda n, x: n + F.when(F.octet_length(x) >= LONG_LINE, F.octet_length(x)).otherwise(0))
    return (long * 2 > F.octet_length(text)) & (F.floor(F.octet_length(text) / F.size(lines)) >= LONG_AVERAGE)


def leading_comments(text: Column) -> Column:
    """The lines of the comment that opens a file, trimmed, up to the first line of code."""
    lines = F.transform(F.split(text, "\n", -1), F.trim)
    start = F.struct(F.lit(False).alias("within"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        directive = F.lit(False)
        for d in DIRECTIVES:
            directive = directive | x.startswith(d)
        opens, blank = x.startswith("/*"), x.isin("", "<?php")
        comment = s["within"] | opens | x.startswith("<!--") | x.startswith("//") | x.startswith("--") | (x.startswith("#") & ~directive)
        done = s["done"] | (~comment & ~blank)
        keep = ~done & comment
        return F.struct(
            F.when(done, False).when(s["within"] | opens, ~x.contains("*/")).otherwise(False).alias("within"), done.alias("done"), F.when(keep, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out")
        )

    return F.aggregate(lines, start, step, lambda s: s["out"])


def is_generated(path: Column, text: Column) -> Column:
    """Whether a file is machine-written or minified; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    low, head = F.lower(path), F.substring(text, 1, HEAD)
    out = F.lit(False)
    for e in GENERATED_ENDINGS:
        out = out | low.endswith(e)
    banner = "(?i)" + "|".join(f"(?:{m})" for m in BANNER_MARKS)
    told = F.exists(leading_comments(head), lambda x: F.regexp_replace(x, r"^[/*#\-<!; \t]+", "").rlike(banner))
    return F.coalesce(out, F.lit(False)) | head.rlike("(?i)" + "|".join(STRONG_MARKS)) | told | is_minified(text)
