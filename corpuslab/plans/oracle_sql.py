"""The same queries as SQL on the driver tables, for the cross-check."""
from corpuslab import constants as K
from corpuslab.functions.tokens import stop_words
from corpuslab.plans.query_inputs import KEYWORDS, LIBRARY_STOP_WORDS

# The other engine spells two code points of the space class differently.
_SPACE = K.SPACE_CHARS.replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}")
_WORD = K.WORD_CHARS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(c: str) -> str:
    pattern = _q(f"[^{_SPACE}{_WORD}]+")
    return f"lower(replace(regexp_replace({c}, {pattern}, ' ', 'g'), '  ', ' '))"


def _normal(c: str) -> str:
    pattern = _q(f"[^{_WORD}{_SPACE}{K.KEPT_PUNCTUATION}]+")
    text = f"regexp_replace(coalesce({c}, 'nan'), {pattern}, '', 'g')"
    return f"""'"' || lower(replace({text}, '  ', ' ')) || '"'"""


def _words(c: str, at_least: int = 1) -> str:
    return f"regexp_extract_all({c}, {_q(f'[{_WORD}]{{{at_least},}}')})"


def _any(c: str, keywords) -> str:
    text = f"lower(replace({c}, '-', ' '))"
    return "(" + " or ".join(f"contains({text}, {_q(k)})" for k in keywords) + ")"


_HIT = _any("text", KEYWORDS)
_MAYBE = "case when n_chars >= 50 then text end"


def _gram_list(longest: int) -> str:
    parts = ["t"]
    for n in range(2, longest + 1):
        gram = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
        parts.append(f"list_transform(range(1, greatest(len(t) - {n - 2}, 1)), lambda i: {gram})")
    return " || ".join(parts)


# --- figure windows ------------------------------------------------------------

_S, _W, _D = f"[{_SPACE}]", f"[{_WORD}]", r"\p{Nd}"
_FIG = "[Ff][Ii][Gg]"
_SPACED = "[Ff] [Ii] [Gg] [Uu] [Rr] [Ee]"
_GAP = rf"(?:{_S}|\\n)*"
# A figure mention, as in constants.py, spelled for this engine.
_MENTION = (
    rf"(?:{_FIG}(?:|\.|[Uu][Rr][Ee]|[Ss]\.)|{_SPACED}){_GAP}"
    rf"(?:(?:{_S}|\\n){_W}|{_W}?{_D}+[-\\.]*{_D}*{_W}?)(?:\(|\)|,|\\'|\\.|{_S}|\\n)"
)


def _mentions_cte() -> str:
    return """texts as (select doc_id, source,
        replace(text, 'the ', 'Fig. ' || (doc_id % 7 + 1) || ' ') as text from documents)"""


def _windows_cte(lines: int, width: int) -> str:
    window = _q(rf"((?:\n.*){{0,{lines}}}{_MENTION}(?:.*\n){{0,{lines}}})")
    prefix = _q(rf"(?:{_SPACED}|{_FIG}(?:\.|[Uu][Rr][Ee]|[Ss]\.)){_GAP}")
    noise = _q(rf"{_FIG}|\(|\)|\\'|,|{_S}|\\n")
    return f"""{_mentions_cte()},
      w as (select doc_id, unnest(regexp_extract_all(text, {window}, 1)) as win from texts),
      m as (select doc_id, win, unnest(regexp_extract_all(win, {_q(_MENTION)})) as hit from w),
      ids as (select doc_id, win, regexp_replace(regexp_replace(regexp_replace(
          hit, {prefix}, '', 'g'), {noise}, '', 'g'), '[.-]$', '') as fig_id from m),
      windows as (select distinct doc_id as paper_id,
          case when length(win) > {width} then substring(win, (length(win) - {width}) // 2 + 1, {width})
          else win end as text, fig_id from ids where fig_id <> '')"""


def _windows(lines: int, width: int) -> str:
    return f"with {_windows_cte(lines, width)} select paper_id, text, fig_id from windows"


def _scored_windows() -> str:
    return f"""{_windows_cte(*K.NARROW_WINDOW)},
      logits as (select paper_id, fig_id, text,
          (length(text) - length(replace(text, 'a', ''))) / 16.0::double as l0,
          (length(text) - length(replace(text, 'e', ''))) / 16.0::double as l1 from windows),
      scored as (select paper_id, fig_id, text, (l1 > l0)::int as pred_y,
          1.0 / (1.0 + exp(l0 - l1)) as prob_y from logits),
      figs as (select paper_id, fig_id, avg(pred_y) as mp, avg(prob_y) as mq, count(text) as n
          from scored group by paper_id, fig_id),
      papers as (select paper_id, avg(mq) as prob_y, bool_or(mp > 0.5 and mq > 0.5) as any_fig,
          bool_or(mp > 0.5 and n = 1) as any_take from figs group by paper_id)"""


# --- shared sub-queries ------------------------------------------------------------

_LABELED = """labeled as (select d.doc_id, d.text, l.quality
    from documents d join labels l on d.doc_id = l.doc_id)"""


def _vocabulary_cte(corpus: str) -> str:
    return f"""n as (select count(*)::double as n from {corpus}),
      toks as (select {_words(_normal('text'), 2)} as t from {corpus}),
      grams as (select unnest(list_distinct({_gram_list(2)})) as term from toks),
      dfs as (select term, count(*) as df from grams group by term),
      vocab as (select term, df, ln((1.0 + n) / (df + 1.0)) + 1.0 as idf from dfs, n
          where df >= 0.05::double * n and df <= 0.9::double * n)"""


def _tfidf(corpus: str) -> str:
    return f"""with {_LABELED}, {_vocabulary_cte(corpus)},
      dt as (select doc_id, {_words(_normal('text'), 2)} as t from labeled),
      dg as (select doc_id, unnest({_gram_list(2)}) as term from dt),
      c as (select doc_id, dg.term, idf, count(*) as tf from dg join vocab on dg.term = vocab.term
          group by doc_id, dg.term, idf)
      select doc_id, term, tf,
          round(tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by doc_id)), 6) as weight from c"""


_STOP = ", ".join(_q(w) for w in stop_words(LIBRARY_STOP_WORDS))


def _content(c: str) -> str:
    return (
        f"list_filter({_words(_plain(c))}, lambda w: w not in ({_STOP}) "
        rf"and not regexp_full_match(w, '\p{{N}}+'))"
    )


def _cloud(rows: str) -> str:
    return f"""t as (select unnest({_content('text')}) as term from {rows}),
        c as (select term, count(*) as n from t group by term),
        top as (select * from c order by n desc, term limit {K.CLOUD_TERMS})
        select term, n, round(n / (max(n) over ())::double, 6) as weight from top"""


def _category_terms() -> str:
    return f"""{_LABELED},
      terms as (select quality, unnest({_content('text')}) as term from labeled),
      cat as (select term, count(*) filter (where quality = 1) as n_pos,
          count(*) filter (where quality is distinct from 1) as n_neg
          from terms group by term having count(*) >= 20)"""


def _scaled(c: str) -> str:
    """Average rank of ties by rank() and the tie count."""
    def unit(e: str) -> str:
        span = f"max({e}) over () - min({e}) over ()"
        return f"coalesce(({e} - min({e}) over ()) / nullif({span}, 0), 0.0)"

    tag = c[2:]
    return (
        f"round({unit(f'dense_{c}::double')}, 6) as dense_{tag}, "
        f"round({unit(f'mean_{c}')}, 6) as percentile_{tag}, "
        f"round({unit(f'log_{c}')}, 6) as log_standard_{tag}"
    )


def _ranks(c: str) -> str:
    return (
        f"dense_rank() over (order by {c}) as dense_{c}, "
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as mean_{c}, "
        f"log2({c} + 1.0::double) as log_{c}"
    )


_PDF_FILES = """files as (select 'corpus/' || source || '/' || lang || '/' || doc_id || '.pdf' as path,
    (doc_id // 2)::varchar as id, text from documents)"""
_PDF_META = """meta as (select doc_id::varchar as id, quality as "Binary" from labels
    union all select doc_id::varchar, toxic from labels where toxic = 1)"""

_METADATA = """metadata as (select doc_id::varchar as "ID", 'author' as "AU", 'title' as "TI",
    'journal' as "JO", (2000 + quality)::varchar as "PY",
    case when toxic = 1 then null when quality = 0 then 2 else 1 end as "Usable", quality from labels),
  pos as (select case when lang in ('de', 'es') then doc_id::varchar else '' end as a,
    case when lang in ('fr', 'es') then (doc_id + 1)::varchar else '' end as b, source, lang from documents),
  allpos as (select a as id from pos where a <> '' union select b from pos where b <> ''),
  fresh as (select id from allpos except select "ID" from metadata)"""

_GOOD = ("Good_figure", "Good_figure_2", "Good_figure_3", "Good_figure_4", "Good_figure_5")
_REFRESHED = f"""{_METADATA},
  refreshed as (select "ID", "AU", "TI", "JO", "PY", "Usable",
      {', '.join(f'0 as "{g}"' for g in _GOOD)},
      ("ID" in (select id from allpos) or coalesce("Usable" > 1, false))::int as "Binary" from metadata
    union all select case when a <> '' then a else b end, lang, source, '', '2020', -1,
      {', '.join('-1' for _ in _GOOD)}, 1 from pos
      where a in (select id from fresh) or b in (select id from fresh))"""

_PREDICTIONS = f"""p as (select source || '-' || lang as paper_id, (doc_id % 5)::varchar as fig_id,
    {_MAYBE} as text, (n_chars % 3 = 0)::int as pred_y, (n_chars % 128) / 128.0::double as prob_y,
    n_chars % 2 as label, source from documents),
  figs as (select paper_id, fig_id, avg(pred_y) as mp, avg(prob_y) as mq, avg(label) as ml,
    count(text) as n from p group by paper_id, fig_id),
  papers as (select paper_id, max((mp > 0.5 and mq > 0.5)::int) as fig_pred,
    max((mp > 0.5 and n = 1)::int) as take, avg(mq) as prob_y, avg(ml) as label
    from figs group by paper_id)"""

_HASH_RANK = "row_number() over (order by md5('{seed}|' || {key}))"


def _doc_rollup(positive: str) -> str:
    return f"""with {_PREDICTIONS} select paper_id, fig_pred, take, round(prob_y, 6) as prob_y,
      ({positive})::int as doc_pred, round(label, 6) as label from papers"""


def _listed(doi: str) -> str:
    return f"""'10.1101/' || {doi} as "ID", json_extract_string(props, '$.k')::int as "Version",
      '"' || event_type || '"' as "Title", '"user ' || user_id || '"' as "Authors",
      strftime(ts, '%Y-%m-%d') as "Date", event_type as "Category", 'NA' as "Published\""""


_JOINED_TEXTS = f"""marks as (select 'doc ' || doc_id as id, * exclude (doc_id) from labels)"""

_NOT_LATIN1 = r"'[^\x{00}-\x{ff}]'"

ORACLES: dict[str, str] = {
    "clean_ids": f"select doc_id, {_plain("source || '-/' || text")} as clean_id from documents",
    "normalize_text": f"select doc_id, {_normal(_MAYBE)} as normalized from documents",
    "keyword_filter": f"select doc_id, lang, source from documents where {_HIT}",
    "length_mask": f"""select doc_id, length({_MAYBE}) as n from documents where length({_MAYBE}) > 200""",
    "id_from_path": r"""with p as (select doc_id, 'corpus/' || source || '/' || lang || ' ' || doc_id || 'v'
          || (n_chars % 3 + 1) || '.full.pdf' as pdf, 'PMC' || doc_id as text_file from documents)
        select doc_id, replace(split_part(pdf, '/', 3), '.pdf', '') as third_part,
          """
    + _plain(r"regexp_extract(pdf, '^[^/]*/(.*?)\.pdf', 1)")
    + r""" || ' pdf' as subfolder,
          '10.1101/' || regexp_extract(pdf, '/([^/v]*)v[0-9]+\.full\.pdf$', 1) as versioned,
          regexp_extract(pdf, 'v([0-9]+)\.full\.pdf$', 1)::int as version, text_file from p""",
    "tokens": f"""with t as (select doc_id, {_words(_normal('text'))} as t from documents)
        select doc_id, len(t) as n, array_to_string(t, '|') as words from t""",
    "ngrams": f"""with t as (select doc_id, {_words('lower(text)', 2)} as t from documents),
        g as (select doc_id, {_gram_list(3)} as g from t)
        select doc_id, len(g) as n, array_to_string(g, '|') as grams from g""",
    "truncate_tokens": f"""select doc_id, array_to_string(({_words('text')})[1:512], ' ') as head
        from documents""",
    "dedup_first": "select distinct text, lang from documents",
    "dedup_none": "select text, lang from documents group by text, lang having count(*) = 1",
    "latest_version": """with f as (select (doc_id // 4)::varchar as id, (n_chars % 3 + 1)::int as version,
          (doc_id // 4) || 'v' || (n_chars % 3 + 1) || '.' || doc_id || '.pdf' as name from documents)
        select name, id, version from f
        qualify row_number() over (partition by id order by version desc, name) = 1""",
    "corpus_union": " union all ".join(
        f"select {_normal('text')} as text from {t}" for t in ("documents", "conversations", "benchmark")
    ),
    "corpus_build": f"""select {_normal('text')} as text, lang from
        (select distinct text, lang from documents where length(text) > 200 and {_HIT})""",
    "stage_audit": f"""with d as (select distinct text, lang from documents where length(text) > 200)
        select 'read' as stage, count(*) as n from documents
        union all select 'downloaded', count(*) from documents where length(text) > 100
        union all select 'long_enough', count(*) from documents where length(text) > 200
        union all select 'distinct', count(*) from d
        union all select 'relevant', count(*) from d where {_HIT}""",
    "csv_roundtrip": """select doc_id::varchar as id, text, (length(text) > 100)::int as downloaded
        from documents""",
    "latin1_ingest": f"""with f as (select 'PMC' || doc_id as id,
          regexp_replace(text, {_NOT_LATIN1}, '?', 'g') as text from documents)
        select id, text, 1 as downloaded from f where {_HIT}""",
    "archive_ingest": f"""select 'PMC' || doc_id as id,
        regexp_replace(text, {_NOT_LATIN1}, '?', 'g') as text, '' as error from documents""",
    "ingest_exact": f"""with {_PDF_FILES}, {_PDF_META},
        f as (select id, min(path) as p from files where length(text) > 100 group by id)
        select '"' || files.id || '"' as id, text, (length(text) > 100)::int as downloaded, "Binary"
        from files join meta on files.id = meta.id left join f on files.id = f.id
        where f.p is null or path <= f.p""",
    "ingest_own": """select '"' || doc_id || '"' as id, text, (length(text) > 100)::int as downloaded,
          quality as "Binary" from documents join labels using (doc_id) where toxic is distinct from 1""",
    "ingest_crawled": """with files as (select 'crawl/Paper' || case when doc_id % 2 = 0 then '-' else ':' end
            || (doc_id // 2) || '.pdf' as path, 'paper ' || (doc_id // 2) || ' pdf' as id, text from documents),
        f as (select id, min(path) as p from files where length(text) > 100 group by id)
        select files.id, text, (length(text) > 100)::int as downloaded
        from files join (select distinct 'paper ' || doc_id || ' pdf' as id from labels) meta on files.id = meta.id
          left join f on files.id = f.id where f.p is null or path <= f.p""",
    "orphans": f"""with {_PDF_FILES}, {_PDF_META}
        select path, id from files where id not in (select id from meta)""",
    "ingest_versioned": f"""with m as (select doc_id // 3 as k, doc_id % 3 + 1 as v, 'first' as title from labels
          union select doc_id // 3, doc_id % 3 + 1, 'second' from labels where toxic = 1),
        u as (select k, v from m group by k, v having count(*) = 1)
        select '10.1101/' || (doc_id // 3) as id, text, 1 as downloaded from documents
        join u on doc_id // 3 = k and doc_id % 3 + 1 = v where length(text) > 100 and {_HIT}""",
    "json_ingest": f"""select {_listed('user_id')} from events
        qualify row_number() over (partition by user_id order by event_id) = 1""",
    "stream_ingest": f"select {_listed('event_id')} from events",
    "label_diff": f"""with {_METADATA}
        select id, 'new' as change from fresh
        union all select "ID", 'dropped' from metadata where "ID" not in (select id from allpos)
        union all select "ID", 'conflict' from metadata where "ID" not in (select id from allpos)
          and "Usable" > 1""",
    "metadata_refresh": f"""with {_REFRESHED}
        select * replace (coalesce("Usable", -9) as "Usable") from refreshed""",
    "label_refresh": f"""with {_REFRESHED} select "ID", "PY", 'iGEM' as "Dataset", "Binary" from refreshed
        union all select 'b' || item_id, '2001', 'crawler', 0 from benchmark""",
    "labeled_examples": f"""with {_JOINED_TEXTS},
        e as (select 'doc ' || d.doc_id as id, 2000 + toxic as year, {_normal('text')} as text,
          quality as label from documents d join marks m on m.id = 'doc ' || d.doc_id)
        select *, case when {_HASH_RANK.format(seed=42, key='id')} <=
          floor(0.2::double * count(*) over ()) then 'test' else 'train' end as split from e""",
    "balanced_examples": f"""with m as (select doc_id, 2000 + toxic as year,
          case when toxic = 1 then quality else 1 - quality end as label,
          case when toxic = 0 then '0' when quality = 1 then (doc_id % 5)::varchar end as tf from labels),
        f as (select doc_id, text, (doc_id % 5)::varchar as fig_id from documents where length(text) > 200),
        j as (select 'doc ' || m.doc_id as id, year, text, label, fig_id, tf
          from m left join f on m.doc_id = f.doc_id),
        pos as (select * from j where tf <> '0' and tf = fig_id),
        neg as (select * from j where tf = '0' and label = 0
          qualify {_HASH_RANK.format(seed=42, key='id')} <= (select count(*) from pos)),
        b as (select id, year, {_normal('text')} as text, label, fig_id
          from (select * from pos union all select * from neg) where text is not null)
        select *, case when {_HASH_RANK.format(seed=43, key='id')} <=
          floor(0.2::double * count(*) over ()) then 'test' else 'train' end as split from b""",
    "exact_split": f"""select doc_id, lang, case when {_HASH_RANK.format(seed=42, key='doc_id')} <=
        floor(0.2::double * count(*) over ()) then 'test' else 'train' end as split from documents""",
    "holdout": f"""select o_orderkey, case when {_HASH_RANK.format(seed=42, key='o_orderkey')} <= 1000
        then 'cv' else 'train' end as split from orders""",
    "classifier_splits": f"""with {_LABELED},
        e as (select *, {_HASH_RANK.format(seed=42, key='doc_id')} <=
          floor(0.2::double * count(*) over ()) as is_test from labeled),
        r as (select *, {_HASH_RANK.replace('(order', '(partition by is_test order').format(seed=7, key='doc_id')}
          as rn from e)
        select text, quality as label, case when is_test then 'test' when rn <= 100 then 'cv'
          else 'train' end as split from r""",
    "sample_fraction": f"""select doc_id, lang from documents
        qualify {_HASH_RANK.format(seed=42, key='doc_id')} <= round_even(0.01 * count(*) over (), 0)""",
    "positional_join": """with a as (select doc_id, n_chars, row_number() over (order by doc_id) - 1 as row_index
          from documents),
        b as (select conv_id, turn, role, row_number() over (order by conv_id, turn) - 1 as row_index
          from conversations)
        select a.row_index, doc_id, n_chars, conv_id, turn, role from a join b on a.row_index = b.row_index""",
    "figure_windows_wide": _windows(*K.WIDE_WINDOW),
    "figure_windows_narrow": _windows(*K.NARROW_WINDOW),
    "vocabulary": f"""with {_LABELED}, {_vocabulary_cte('labeled')}
        select term, df, round(idf, 6) as idf from vocab""",
    "tfidf": _tfidf("labeled"),
    "tfidf_corpus": _tfidf("documents"),
    "class_weights": """select quality, count(*) as n,
        round(sum(count(*)) over () / (count(*) over () * count(*)::double), 6) as weight
        from labels group by quality""",
    "figure_rollup": f"""with {_PREDICTIONS} select paper_id, fig_id, round(mp, 6) as mean_pred,
        round(mq, 6) as mean_prob, round(ml, 6) as mean_label, n as n_texts,
        (mp > 0.5 and mq > 0.5)::int as fig_pred, (mp > 0.5 and n = 1)::int as take from figs""",
    "doc_rollup": _doc_rollup("prob_y > 0.5"),
    "doc_rollup_intended": _doc_rollup("prob_y > 0.5 or fig_pred = 1 or take = 1"),
    "positive_docs": f"""with {_PREDICTIONS} select paper_id, round(prob_y, 6) as prob_y, 1 as doc_pred
        from papers where prob_y > 0.5""",
    "positive_share": f"""with {_PREDICTIONS}
        select source, round(avg(pred_y), 6) as share, count(*) as n from p group by source""",
    "eval_metrics": """with p as (select quality as y, n_chars % 2 as g
          from documents d join labels l on d.doc_id = l.doc_id),
        c as (select count(*) filter (where y = 1 and g = 1)::double as tp,
          count(*) filter (where y = 0 and g = 1)::double as fp,
          count(*) filter (where y = 1 and g = 0)::double as fn,
          count(*) filter (where y = 0 and g = 0)::double as tn,
          count(*) filter (where not (y in (0, 1) and g in (0, 1)) or y is null or g is null)::double as n_other from p)
        select 'n_other' as metric, n_other as value from c union all select 'tp', tp from c union all select 'fp', fp from c
        union all select 'fn', fn from c union all select 'tn', tn from c
        union all select 'accuracy', round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) from c
        union all select 'sensitivity', round(tp / nullif(tp + fn, 0), 6) from c
        union all select 'specificity', round(tn / nullif(tn + fp, 0), 6) from c
        union all select 'f1', round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) from c""",
    "logits_to_pred": """select vec_id, (embedding[2] > embedding[1])::int as pred_y,
        round(1.0 / (1.0 + exp(embedding[1]::double - embedding[2]::double)), 6) as prob_y from embeddings""",
    "knn_classify": """with v as (select vec_id, embedding::double[] as e, label from embeddings),
        r as (select a.vec_id, b.label from v a join v b on a.vec_id <> b.vec_id
          qualify row_number() over (partition by a.vec_id order by list_distance(a.e, b.e), b.vec_id) <= 5),
        c as (select vec_id, label, count(*) as n from r group by vec_id, label),
        s as (select vec_id, round(count(*) filter (where label = 1) / count(*)::double, 6) as prob_y
          from r group by vec_id)
        select c.vec_id, c.label as pred_y, prob_y from c join s on c.vec_id = s.vec_id
        qualify row_number() over (partition by c.vec_id order by n desc, c.label) = 1""",
    "model_knn": f"""with {_LABELED},
        e as (select doc_id, text, quality, {_HASH_RANK.format(seed=42, key='doc_id')} <=
          floor(0.2::double * count(*) over ()) as is_test from labeled),
        train as (select * from e where not is_test),
        {_vocabulary_cte('train')},
        dt as (select doc_id, {_words(_normal('text'), 2)} as t from e),
        dg as (select doc_id, unnest({_gram_list(2)}) as term from dt),
        c as (select doc_id, dg.term, idf, count(*) as tf from dg join vocab on dg.term = vocab.term
          group by doc_id, dg.term, idf),
        w as (select doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by doc_id)) as weight from c),
        s as (select doc_id, sum(weight * weight) as square from w group by doc_id),
        x as (select e.*, coalesce(square, 0.0) as square from e left join s using (doc_id)),
        p as (select q.doc_id as q_id, b.doc_id as b_id, sum(q.weight * b.weight) as product
          from w q join w b on q.term = b.term where q.doc_id in (select doc_id from x where is_test)
            and b.doc_id in (select doc_id from train) group by all),
        r as (select q.doc_id as id, q.quality as label, b.quality as vote from x q join x b on q.is_test and not b.is_test
          left join p on p.q_id = q.doc_id and p.b_id = b.doc_id
          qualify row_number() over (partition by q.doc_id order by
            sqrt(round(greatest(q.square + b.square - 2 * coalesce(product, 0.0), 0.0), 9)), b.doc_id) <= 3)
        select id, label, case when 2 * sum(vote) > count(*) then 1 else 0 end as pred_y,
          round(sum(vote) / count(*)::double, 6) as prob_y from r group by id, label""",
    "similar_topk": """with v as (select vec_id, embedding::double[] as e from embeddings),
        r as (select a.vec_id as query_id, b.vec_id as neighbour_id, list_cosine_similarity(a.e, b.e) as s
          from v a join v b on a.vec_id <> b.vec_id)
        select query_id, neighbour_id,
          (row_number() over (partition by query_id order by s desc, neighbour_id))::int as rank,
          round(s, 6) as similarity from r
        qualify row_number() over (partition by query_id order by s desc, neighbour_id) <= 20""",
    "positive_papers": f"""with {_scored_windows()}
        select paper_id, round(prob_y, 6) as prob_y, 1 as doc_pred from papers where prob_y > 0.5""",
    "paper_share": f"""with {_scored_windows()}
        select source, round(avg((prob_y > 0.5 or any_fig or any_take)::int), 6) as share, count(*) as n
        from papers join texts on paper_id = doc_id group by source""",
    "term_freq": f"with {_cloud('documents')}",
    "term_freq_positive": f"with {_LABELED}, {_cloud('labeled where quality = 1')}",
    "category_terms": f"with {_category_terms()} select term, n_pos, n_neg from cat",
    "term_scalers": f"""with {_category_terms()},
        r as (select term, n_pos, n_neg, {_ranks('n_pos')}, {_ranks('n_neg')} from cat)
        select term, n_pos, n_neg, {_scaled('n_pos')}, {_scaled('n_neg')} from r""",
    "year_histogram": """with y as (select year(o_orderdate) as y, count(*) as n from orders group by 1),
        r as (select *, row_number() over (order by y) - 1 as pos, sum(n) over () as total from y),
        g as (select case when pos < 2 then 'earlier' else y::varchar end as label, sum(n) as n,
          max(total) as total from r where pos < 6 group by 1)
        select label, n::bigint as n, total::bigint as total,
          round(n / (sum(n) over ())::double, 6) as share from g""",
    "rare_entities": f"""with w as (select unnest({_words(_plain('text'))}) as word from documents)
        select word, count(*) as count from w group by word having count(*) <= 10""",
}
