"""The queries of this package's operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable


from quern.llm import forest, jaccard, kdmeans, language, licences, lines, lm, mixing, pieces, quality, repeats, spelling, tokens


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable]:
    return {
        "op1_licences": licences.op1_licences,
        "op2_pieces": pieces.op2_pieces,
        "op3_repeats": repeats.op3_repeats,
        "op4_embeddings": forest.op4_embeddings,
        "op5_lines": lines.op5_lines,
        "op6_mixing": mixing.op6_mixing,
        "op7_lm": lm.op7_lm,
        "op8_quality": quality.op8_quality,
        "op9_token_ids": tokens.op9_token_ids,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_language": language.op11_language,
        "op12_centroids": kdmeans.op12_centroids,
        "op13_spelling": spelling.op13_spelling,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_embeddings": forest.OP4_SQL, "op6_mixing": mixing.OP6_SQL, "op10_jaccard": jaccard.OP10_SQL, "op12_centroids": kdmeans.OP12_SQL, "op13_spelling": spelling.OP13_SQL}
