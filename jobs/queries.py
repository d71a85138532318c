"""The jobs as registered queries: each runs twice into one new folder and returns what is there then."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from jobs import observation_stream, word_screen
from terrane.operators.lineage import checkpoint_folder
from terrane.plans.evidence_queries import _CORR, EV
from terrane.plans.registry import with_parts

#: Labelled documents that hold a word, in the registered query.
MIN_DOCUMENTS = 5


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared checkpoint folder; its files stay."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def job1_observation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence screen of all observations, taken from a file stream."""
    at = _folder(spark, "job1")
    config = observation_stream.Config(f"{sf_dir}/embeddings.parquet*", f"{at}/out", f"{at}/checkpoint")
    for _ in range(2):
        observation_stream.run(spark, config)
    return observation_stream.screened(spark, config.out)


def job2_word_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all words of the labelled documents."""
    at = _folder(spark, "job2")
    config = word_screen.Config(f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at, min_documents=MIN_DOCUMENTS)
    for _ in range(2):
        word_screen.run(spark, config)
    return word_screen.words_of(spark, at)


_JOB1 = {
    "paired": "select t.obs_id, e.label domain, t.var_id - 3 gene, d.var_id - 11 enh, greatest(d.value, 0) x, greatest(t.value, 0) y from cells t join cells d on t.obs_id = d.obs_id and t.var_id between 3 and 10 and d.var_id >= 11 join embeddings e on e.vec_id = t.obs_id",
}
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_JOB2 = {
    "lab": "select doc_id, 'quality' gene, quality::double y from labels where quality is not null union all select doc_id, 'toxic', toxic::double from labels where toxic is not null",
    "doc": rf"select doc_id, coalesce(lang, 'none') domain, list_distinct(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) words from documents",
    "rows_": "select gene, domain, y, words from doc join lab using (doc_id)",
    "tot": "select gene, domain, count(*) n, sum(y) ny, sum(y * y) nyy from rows_ group by all",
    "there": "select gene, domain, enh, count(*) nx, sum(y) nxy from (select gene, domain, y, unnest(words) enh from rows_) group by all",
    "often": f"select gene, enh, sum(nx)::bigint n_documents from there group by all having sum(nx) >= {MIN_DOCUMENTS}",
    # sums of a presence x: of x and of its square nx, of the product nxy
    "sums": "select o.gene, enh, n_documents, t.domain, n, coalesce(nx, 0) sx, coalesce(nx, 0) sxx, ny sy, nyy syy, coalesce(nxy, 0) sxy from often o join tot t using (gene) left join there using (gene, enh, domain)",
    "loc": f"select gene, enh, domain, n, {_CORR} as \"local\" from sums",
    **{k: EV[k] for k in ("glo", "rk", "best", "adv", "ev", "cl")},
}
QUERIES = {f.__name__: f for f in (job1_observation_stream, job2_word_screen)}
ORACLES = {
    "job1_observation_stream": with_parts("cells", "select * from cl", _JOB1 | EV),
    "job2_word_screen": with_parts("", "select gene as target, enh as word, n_documents, cl.* exclude (gene, enh) from cl join often using (gene, enh)", _JOB2),
}
