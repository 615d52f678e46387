"""The registered queries in SQL, for checking results with another engine."""

from __future__ import annotations

from tablewright.demo.views import KEYS, SUBJECTS
from tablewright.operators import chat, mixing, preference
from tablewright.operators.results import MODELS


def text(value: str) -> str:
    """An SQL literal; line breaks are spelled with chr(10)."""
    lines = [f"'{line}'" for line in value.replace("'", "''").split("\n")]
    return "(" + " || chr(10) || ".join(lines) + ")"


def array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def draw(tag: str, key: str, n: int | str) -> str:
    return f"(('0x' || substr(md5('{tag}:' || {key}), 1, 8))::BIGINT % {n})"


def pieces(parts: int) -> str:
    indexes = ", ".join(map(str, range(parts)))
    return f"""SELECT doc_id AS example_id,
        list_transform([{indexes}], lambda i: substr(text, 1 + i * s, s)) AS p
        FROM (SELECT doc_id, text, (length(text) + {parts - 1}) // {parts} AS s FROM documents)"""


def brand(step: int, choices: int) -> str:
    indexes = ", ".join(map(str, range(choices)))
    return (
        f"list_transform([{indexes}], lambda i: "
        f"'Brand#' || (1 + (p_partkey + {step} * i) % 25) || ' ' || p_type)"
    )


QUESTION = "'Which brand makes the ' || p_name || ' number ' || p_partkey || '?'"
LABEL_INDEX = "TRY_CAST(trim(label) AS INT)"

VIEWS = {
    "hella": f"""SELECT example_id, p[1] AS ctx,
        list_transform([0, 1, 2, 3], lambda i: p[2 + (i - lab + 4) % 4]) AS endings,
        CAST(lab AS VARCHAR) AS label
        FROM (SELECT *, {draw('lab', 'example_id', 4)} AS lab FROM ({pieces(5)}))""",
    "damaged": """SELECT example_id, ctx,
        CASE WHEN example_id % 17 = 2 THEN endings[1:1] ELSE endings END AS endings,
        CASE example_id % 17 WHEN 0 THEN '' WHEN 1 THEN '7' WHEN 2 THEN '0' ELSE label END AS label
        FROM hella""",
    "piqa": f"""SELECT example_id, p[1] AS goal, p[2 + lab] AS sol1, p[3 - lab] AS sol2,
        CAST(lab AS INT) AS label
        FROM (SELECT *, {draw('piqa', 'example_id', 2)} AS lab FROM ({pieces(3)}))""",
    "wino": f"""SELECT example_id,
        p[1] || CASE WHEN example_id % 20 = 1 THEN '' ELSE '_' END || p[2]
            || CASE WHEN example_id % 20 = 0 THEN '_' || p[3] ELSE '' END AS sentence,
        p[3] AS option1, p[4] AS option2,
        CASE WHEN example_id % 25 = 0 THEN '' ELSE CAST(1 + {draw('wino', 'example_id', 2)} AS VARCHAR) END AS answer
        FROM ({pieces(4)})""",
    "batches": """SELECT doc_id, unnest(range(c)) AS item, text, c, s FROM
        (SELECT doc_id, text, doc_id % 4 AS c,
         (length(text) + 2 * greatest(doc_id % 4, 1) - 1) // (2 * greatest(doc_id % 4, 1)) AS s FROM documents)""",
    "files": f"""SELECT source AS dataset, lang || '-' || (doc_id % 3) AS subset,
        CASE WHEN NOT (doc_id % 3 = 2 AND lang = 'de') THEN
            'cache/' || source || '/' || lang || '-' || (doc_id % 3) || '/set' || doc_id || '-'
            || (['validation', 'test', 'train', 'train', 'dev', 'data'])[1 + {draw('split', 'doc_id', 6)}]
            || CASE WHEN {draw('shard', 'doc_id', 2)} = 0 THEN '' ELSE '-00000-of-00002' END || '.arrow'
        END AS path
        FROM documents""",
    "arc": f"""SELECT p_partkey AS example_id, {QUESTION} AS question, {brand(7, 4)} AS texts, labels,
        CASE WHEN p_partkey % 50 = 7 THEN 'F' WHEN p_partkey % 50 = 9 THEN 'E'
             WHEN p_partkey % 50 = 10 THEN '5' ELSE labels[1 + {draw('arc', 'p_partkey', 4)}] END AS answerKey
        FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN ['1', '2', '3', '4'] ELSE ['A', 'B', 'C', 'D'] END AS labels
              FROM part)""",
    "csqa": f"""SELECT p_partkey AS example_id, {QUESTION} AS question, {brand(3, 5)} AS texts, labels,
        CASE WHEN p_partkey % 10 = 0 THEN CAST(1 + {draw('csqa', 'p_partkey', 5)} AS VARCHAR)
             ELSE labels[1 + {draw('csqa', 'p_partkey', 5)}] END AS answerKey
        FROM (SELECT *, ['A', 'B', 'C', 'D', 'E'] AS labels FROM part)""",
    "mmlu": f"""SELECT p_partkey AS example_id, ({array(SUBJECTS)})[1 + {draw('subj', 'p_partkey', len(SUBJECTS))}] AS subject,
        {QUESTION} AS question,
        CASE WHEN p_partkey % 100 = 5 THEN {brand(2, 8)} ELSE {brand(2, 4)} END AS choices,
        CASE WHEN p_partkey % 100 = 3 THEN -1 ELSE CAST({draw('mmlu', 'p_partkey', 4)} AS INT) END AS answer
        FROM part""",
    "gsm": f"""SELECT example_id,
        'Customer ' || o_custkey || ' places order ' || example_id
        || '. What is a thousand times the first number plus the second?' AS question,
        'We multiply, then we add.' || chr(10) || '#### ' || format('{{:,}}', value) AS answer,
        CASE kind
            WHEN 0 THEN '1 step.' || chr(10) || '#### ' || format('{{:,}}', value)
            WHEN 1 THEN 'I get 12 first and then ' || value || ' in all.'
            WHEN 2 THEN 'The answer is ' || (value + 1) || '.'
            WHEN 3 THEN 'I cannot tell.' END AS prediction
        FROM (SELECT o_orderkey AS example_id, o_custkey, o_custkey * 1000 + o_orderkey AS value,
              {draw('gsm', 'o_orderkey', 5)} AS kind FROM orders)""",
    "logits": """SELECT vec_id, label AS target, list_transform(embedding, lambda x: x::DOUBLE) AS x,
        list_max(embedding)::DOUBLE AS top FROM embeddings""",
    "token_lp": f"""SELECT vec_id, vec_id // 32 AS example_id, CAST((vec_id // 8) % 4 AS INT) AS cand,
        vec_id % 8 AS pos, 1 + {draw('ctx', '(vec_id // 8)', 8)} AS ctx_len,
        x[1 + target] - top - ln(list_sum(list_transform(x, lambda v: exp(v - top)))) AS lp FROM logits""",
    "entries": """SELECT event_type || '_u' || (user_id % 10) AS prefix, 'run-' || (event_id // 40) AS run_dir,
        CASE WHEN event_id % 11 = 0 THEN 'final_model' WHEN event_id % 3 = 0 THEN 'checkpoint-' || event_id
             ELSE 'log-' || event_id END AS entry, ts AS mtime FROM events""",
    "turns": f"""SELECT conv_id, turn,
        CASE WHEN conv_id % 5 = 1 AND turn % 4 > 1 THEN 'tool' WHEN conv_id % 7 = 2 AND turn = 2 THEN 'system'
             ELSE role END AS role,
        CASE WHEN role = 'assistant' AND {draw('think', '(conv_id * 1000 + turn)', 3)} = 0
                 THEN '<think>' || chr(10) || 'step ' || turn || chr(10) || '</think>' || chr(10) || chr(10) || text
             WHEN role = 'user' AND conv_id % 6 = 0 AND turn > 1
                 THEN '<tool_response>' || text || '</tool_response>'
             ELSE text END AS text
        FROM conversations""",
    "answers": f"""SELECT *, ('0x' || substr(md5(model || ':' || dataset || ':' || example_id), 1, 8))::BIGINT % 4 AS prediction
        FROM (SELECT 'MMLU' AS dataset, subject AS subset, example_id, answer AS label FROM mmlu
              UNION ALL SELECT 'HellaSwag', '', example_id, CAST(label AS INT) FROM hella),
             (SELECT unnest({array(MODELS)}) AS model)""",
    "summary": """SELECT model, CASE WHEN subset <> '' THEN dataset || ' - ' || subset ELSE dataset END AS dataset,
        avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)::DOUBLE AS raw,
        sum(CASE WHEN prediction = label THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
        FROM answers GROUP BY model, dataset, subset""",
    "shown_summary": """SELECT model, dataset, printf('%.2f%%', accuracy * 100) AS shown FROM summary""",
    "read_summary": f"""SELECT model, dataset, 'Accuracy' AS metric, rtrim(shown, '%')::DOUBLE / 100.0 AS value
        FROM (SELECT model, dataset, shown FROM shown_summary UNION ALL
            SELECT '{MODELS[0]}', 'GSM8K', printf('%.2f%%', count(*) FILTER (correct) / count(*)::DOUBLE * 100) FROM graded)""",
}


SUMMARY_VIEWS = ("mmlu", "hella", "answers", "summary", "shown_summary", "gsm", "graded", "read_summary")


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)


def number(column: str) -> str:
    tail = f"list_extract(string_split({column}, '####'), -1)"
    return f"list_extract(regexp_extract_all(replace({tail}, ',', ''), '-?\\d+\\.?\\d*'), -1)"


GRADED = f"""
    SELECT example_id, question, target, prediction, extracted_pred, extracted_target,
        coalesce(abs(extracted_pred::DOUBLE - extracted_target::DOUBLE) < 1e-6, false) AS correct
    FROM (SELECT example_id, question, answer AS target, prediction,
          {number('prediction')} AS extracted_pred, {number('answer')} AS extracted_target FROM gsm)"""

VIEWS["graded"] = GRADED

PASS = """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id"""


def choice_prompt(labels: str, texts: str) -> str:
    lines = (
        f"array_to_string(list_transform(range(1, least(len({labels}), len({texts})) + 1), "
        f"lambda i: {labels}[i] || '. ' || {texts}[i] || chr(10)), '')"
    )
    return f"question || chr(10) || chr(10) || {lines} || chr(10) || 'Answer:'"


LETTERS = "['A', 'B', 'C', 'D', 'E', 'F']"
LABELLED = f"SELECT example_id, {choice_prompt('labels', 'texts')} AS prompt, answerKey AS target"
POSITIONAL = f"""SELECT example_id, subject, {choice_prompt(LETTERS, 'choices')} AS prompt,
    ({LETTERS}[:least(6, len(choices))])[CASE WHEN answer < 0 THEN answer ELSE answer + 1 END] AS target FROM mmlu"""

MIXTURE = f"""{with_views('arc', 'csqa', 'mmlu', 'gsm')},
    lettered AS ({POSITIONAL}),
    mixture AS (
        SELECT 'commonsense' AS source, example_id::VARCHAR AS id, prompt, target FROM ({LABELLED} FROM csqa)
        UNION ALL SELECT 'science', example_id::VARCHAR, prompt, target FROM ({LABELLED} FROM arc)
        UNION ALL SELECT 'math', example_id::VARCHAR, question, answer
            FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || example_id)) AS r, count(*) OVER () AS n FROM gsm)
            WHERE r <= n - ceil(0.7::DOUBLE * n)
        UNION ALL SELECT 'subjects', example_id::VARCHAR, prompt, target
            FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || example_id)) AS r FROM lettered
                  WHERE subject IN ({', '.join(f"'{s}'" for s in mixing.TRAINING_SUBJECTS)})) WHERE r <= 5000
        UNION ALL SELECT 'code', range::VARCHAR, {text(mixing.CODE_PROMPT)}, {text(mixing.CODE_SOLUTION)}
            FROM range({mixing.CODE_ROWS}))"""

PAIRS = f"""
    SELECT example_id, {text(preference.INSTRUCTION)} || ctx AS prompt, endings[1 + lab] AS chosen,
        endings[1 + CASE WHEN d >= lab THEN d + 1 ELSE d END] AS rejected
    FROM (SELECT *, {LABEL_INDEX} AS lab, {draw('rejected', 'example_id', 'greatest(len(endings) - 1, 1)')} AS d
          FROM {{table}})
    WHERE lab >= 0 AND lab < len(endings) AND len(endings) > 1"""

WRAPPED = f"""
    SELECT example_id, {text(chat.START + 'user' + chr(10))} || prompt
        || {text(chat.END + chr(10) + chat.ASSISTANT_OPEN)} AS prompt,
        chosen || '{chat.END}' AS chosen, rejected || '{chat.END}' AS rejected FROM pairs"""


def turn(role: str, content: str) -> str:
    return f"'{chat.START}' || {role} || chr(10) || {content} || {text(chat.END + chr(10))}"


def several_keys(*columns: str) -> str:
    """The seeded digest of a row with several keys."""
    parts = (f"':' || length(({c})::VARCHAR) || ':' || {c}" for c in columns)
    return f"md5('42' || {' || '.join(parts)})"


def first_words_end(n: str, w: str = "w", gaps: str = "gaps", n_gaps: str | None = None) -> str:
    """Where the first ``n`` words of a text end, or the ``n_gaps``-th gap; gap i stands before word i."""
    sizes = [f"list_sum(list_transform({part}[:{k}], lambda x: length(x)))" for part, k in ((w, n), (gaps, n_gaps or n))]
    return " + ".join(f"coalesce({size}, 0)" for size in sizes)


def words_and_gaps(column: str) -> str:
    return f"{words(column)} AS w_{column}, string_split_regex({column}, '\\S+') AS g_{column}"


def cut_start(column: str, n: str) -> str:
    """The first ``n`` words of a text, or the whole text where it has no more."""
    end = first_words_end(n, f"w_{column}", f"g_{column}")
    return f"CASE WHEN len(w_{column}) <= {n} THEN {column} ELSE left({column}, ({end})::INT) END AS {column}"


def rendered(source: str, piece: str, closing: str = "''") -> str:
    return f"""SELECT conv_id, count(*) AS n_turns,
        string_agg({piece}, '' ORDER BY turn) || {closing} AS text FROM {source} GROUP BY conv_id"""


TEMPLATE_PIECES = f"""
    marks AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        coalesce(lag(role) OVER w, '') AS before, coalesce(lead(role) OVER w, '') AS after
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    lasts AS (SELECT *, coalesce(max(CASE WHEN role = 'user' AND NOT (starts_with(text, '<tool_response>')
        AND ends_with(text, '</tool_response>')) THEN k END) OVER (PARTITION BY conv_id), n) AS last_query FROM marks),
    thoughts AS (SELECT *,
        CASE WHEN contains(text, '</think>') THEN ltrim(list_extract(string_split(
            rtrim(string_split(text, '</think>')[1], chr(10)), '<think>'), -1), chr(10)) ELSE '' END AS reasoning,
        CASE WHEN contains(text, '</think>')
            THEN ltrim(list_extract(string_split(text, '</think>'), -1), chr(10)) ELSE text END AS content
        FROM lasts),
    template AS (SELECT conv_id, turn, CASE
        WHEN role IN ('user', 'system') THEN {turn('role', 'text')}
        WHEN role = 'assistant' AND k > last_query AND (k = n OR reasoning <> '') THEN
            {turn('role', "'<think>' || chr(10) || trim(reasoning, chr(10)) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(content, chr(10))")}
        WHEN role = 'assistant' THEN {turn('role', 'content')}
        WHEN role = 'tool' THEN CASE WHEN before = 'tool' THEN '' ELSE '{chat.START}user' END
            || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>'
            || CASE WHEN after = 'tool' THEN '' ELSE {text(chat.END + chr(10))} END
        ELSE '' END AS piece FROM thoughts)"""


def cand(source: str, context: str, texts: str, label: str, where: str = "", extra: str = "") -> str:
    columns = f"example_id, {extra + ', ' if extra else ''}label, context, cand, candidate"
    return f"""SELECT {columns} FROM (
        SELECT *, unnest(range(len(texts_)))::INT AS cand, unnest(texts_) AS candidate FROM (
            SELECT *, {context} AS context, {texts} AS texts_ FROM (SELECT * REPLACE_OR_ADD FROM {source})) {where})""".replace(
        "* REPLACE_OR_ADD", label
    )


QUESTION_CONTEXT = "'Question: ' || question || chr(10) || 'Answer:'"
SPACED = "list_transform({}, lambda t: ' ' || t)"
ARC_LABEL = """*, coalesce(list_position(['A', 'B', 'C', 'D', 'E'], answerKey),
    list_position(['1', '2', '3', '4'], answerKey)) - 1 AS label"""
CSQA_LABEL = "*, list_position(['A', 'B', 'C', 'D', 'E'], answerKey) - 1 AS label"
IN_RANGE = "WHERE label < len(texts_)"

CANDIDATES = {
    "arc": cand("arc", QUESTION_CONTEXT, SPACED.format("texts"), ARC_LABEL, IN_RANGE),
    "csqa": cand("csqa", QUESTION_CONTEXT, SPACED.format("texts"), CSQA_LABEL, IN_RANGE),
    "mmlu": cand("mmlu", QUESTION_CONTEXT, SPACED.format("choices"), "*, answer AS label", extra="subject AS subset"),
    "piqa": cand(
        "piqa", "'Question: ' || goal || chr(10) || 'Answer:'", SPACED.format("[sol1, sol2]"), "*"
    ),
    "hella": cand("hella", "ctx", SPACED.format("endings"), f"* REPLACE ({LABEL_INDEX} AS label)"),
    "wino": cand(
        "wino",
        "string_split(sentence, '_')[1]",
        "[option1 || coalesce(string_split(sentence, '_')[2], ''), option2 || coalesce(string_split(sentence, '_')[2], '')]",
        "*, CASE answer WHEN '1' THEN 0 WHEN '2' THEN 1 END AS label",
        "WHERE label IS NOT NULL",
    ),
}

TASK_VIEWS = ("arc", "csqa", "mmlu", "piqa", "hella", "wino")
ALL_CANDIDATES = "items AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, {subset} AS subset, example_id, label, context, cand, candidate FROM ({CANDIDATES[key]})"
    for name, key, subset in [
        ("ARC", "arc", "''"),
        ("CommonsenseQA", "csqa", "''"),
        ("MMLU", "mmlu", "subset"),
        ("PIQA", "piqa", "''"),
        ("HellaSwag", "hella", "''"),
        ("Winogrande", "wino", "''"),
    ]
) + ")"


def words(column: str) -> str:
    return f"regexp_extract_all({column}, '\\S+')"


def bigram_scores(mode: str) -> str:
    """CTEs from ``items`` to ``scores``."""
    start = f"len({words('context')})" if mode == "reference" else f"greatest(len({words('context')}) - 1, 0)"
    return f"""
    doc_words AS (SELECT {words('text')} AS w FROM documents),
    doc_pairs AS (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM doc_words WHERE len(w) > 1),
    n_ab AS (SELECT a, b, count(*) AS n_ab FROM doc_pairs GROUP BY a, b),
    n_a AS (SELECT a, sum(n_ab) AS n_a FROM n_ab GROUP BY a),
    size AS (SELECT sum(n_a) AS n, count(*) AS v FROM n_a),
    model AS (SELECT a, b, ln((n_ab + 1) / (n_a + v)) AS log_p FROM n_ab JOIN n_a USING (a), size),
    item_words AS (SELECT dataset, subset, example_id, label, cand, {start} AS s,
        {words('context || candidate')} AS w FROM items),
    item_pairs AS (SELECT dataset, subset, example_id, label, cand,
        unnest(w[s + 1:len(w) - 1]) AS a, unnest(w[s + 2:]) AS b FROM item_words WHERE len(w) - 1 > s),
    pair_scores AS (SELECT dataset, subset, example_id, label, cand, sum(coalesce(log_p, ln(1 / (n + v)))) AS score
        FROM item_pairs LEFT JOIN model USING (a, b), size GROUP BY ALL),
    scores AS (SELECT dataset, subset, example_id, label, cand, coalesce(score, -9999.0) AS score
        FROM item_words LEFT JOIN pair_scores USING (dataset, subset, example_id, label, cand))"""


BIGRAMS = with_views(*TASK_VIEWS) + f", {ALL_CANDIDATES}, {bigram_scores('reference')}"
PREDICTED = """predicted AS (SELECT dataset, subset, example_id, label, cand AS prediction FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, subset, example_id ORDER BY round(score, 6) DESC, cand) AS r
        FROM scores) WHERE r = 1)"""
ACCURACY = """sum(CASE WHEN prediction = label THEN 1 ELSE 0 END)::BIGINT AS n_correct, count(*) AS n_total,
    sum(CASE WHEN prediction = label THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy"""

ONE_TASK_SCORES = """{views}, items AS (SELECT 'X' AS dataset, '' AS subset, example_id, label, context, cand, candidate
    FROM ({candidates})), {scores} SELECT example_id, cand, round(score, 4) AS score FROM scores"""


def vowel_predictions(source: str) -> str:
    """CTE ``predicted`` from items with (dataset, subset, example_id, label, context, cand, candidate)."""
    count_a = "(length({0}) - length(replace({0}, 'a', '')))"
    score = (
        f"({count_a.format('context')} + {count_a.format('candidate')})::DOUBLE / (length(context) + length(candidate))"
    )
    return f"""predicted AS (SELECT dataset, subset, example_id, label, cand AS prediction FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, subset, example_id ORDER BY {score} DESC, cand) AS r
        FROM {source}) WHERE r = 1)"""


def token_scores(shift: int) -> str:
    return f"""SELECT example_id, cand, coalesce(sum(CASE WHEN pos >= ctx_len - {shift} THEN lp END), -9999.0) AS score
        FROM token_lp GROUP BY example_id, cand"""


def board(figures: str) -> str:
    """The leaderboard of (model, dataset, metric, value) rows, after the CTEs that make them."""
    return f"""all_rows AS (SELECT model, dataset, metric, value FROM {figures} UNION ALL
            SELECT model, 'MMLU', metric, avg(value) FROM {figures} WHERE starts_with(dataset, 'MMLU - ')
            GROUP BY model, metric),
        wide AS (SELECT dataset, metric, {', '.join(f"max(value) FILTER (model = '{m}') AS {m}" for m in MODELS)}
            FROM all_rows GROUP BY dataset, metric)
        SELECT dataset, metric, {', '.join(f'round({m}, 8) AS {m}' for m in MODELS)},
            {', '.join(f'round({m} - {MODELS[0]}, 8) AS {m}_vs_{MODELS[0]}' for m in MODELS[1:])} FROM wide"""


def resolved(splits: list[str], suffix: bool, fallback: bool) -> str:
    name = "regexp_extract(path, '[^/]*$')"
    hits = [
        f"WHEN ends_with({name}, '{s}.arrow') THEN {i}" if suffix else f"WHEN contains({name}, '{s}') THEN {i}"
        for i, s in enumerate(splits)
    ]
    other = f"WHEN path IS NOT NULL THEN {len(splits)}" if fallback else "WHEN false THEN 0"
    return f"""{with_views('files')},
        ranked AS (SELECT *, CASE {' '.join(hits)} {other} END AS rank FROM files),
        best AS (SELECT dataset, subset, min(rank) AS best FROM ranked GROUP BY dataset, subset)
        SELECT dataset, subset, min(CASE WHEN rank = best THEN path END) AS path,
            count(*) FILTER (rank = best) AS n_files
        FROM ranked JOIN best USING (dataset, subset) GROUP BY dataset, subset"""


def runs(checkpoints: bool) -> str:
    chosen = "coalesce(final, checkpoint)" if checkpoints else "final"
    return f"""{with_views('entries')},
        dirs AS (SELECT prefix, run_dir, max(mtime) AS t, max(entry) FILTER (entry = 'final_model') AS final,
            arg_max(entry, mtime) FILTER (starts_with(entry, 'checkpoint-')) AS checkpoint
            FROM entries GROUP BY prefix, run_dir),
        newest AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY t DESC, run_dir DESC) AS r FROM dirs)
        SELECT prefix, run_dir, {chosen} AS entry FROM newest WHERE r = 1"""


MILLIONTHS = "to_json(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT))::VARCHAR"


def profile() -> str:
    columns = {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate",
        "events": "event_id ts user_id event_type value props",
        "documents": "doc_id text lang source n_chars",
        "embeddings": "vec_id embedding label",
        "pages": "page_id url html",
        "benchmark": "item_id text",
        "labels": "doc_id quality toxic",
        "conversations": "conv_id turn role text",
    }
    parts = []
    for table, names in columns.items():
        order = ", ".join([*KEYS[table], *names.split()])
        for i, name in enumerate(names.split(), start=1):
            value = MILLIONTHS if name == "embedding" else f"{name}::VARCHAR"
            parts.append(
                f"SELECT '{table}' AS table_name, {i} AS ordinal, '{name}' AS column_name, {value} AS example "
                f"FROM (SELECT * FROM {table} ORDER BY {order} LIMIT 1)"
            )
    return " UNION ALL ".join(parts)


SHOWN_ACCURACIES = f"""SELECT dataset, rtrim(printf('%.2f%%', accuracy * 100), '%')::DOUBLE / 100.0 AS value,
            NULL::VARCHAR AS reason, NULL::BIGINT AS n_rows FROM (
            SELECT CASE WHEN subset <> '' THEN dataset || ' - ' || subset ELSE dataset END AS dataset, {ACCURACY}"""

ORACLES = {
    "gsm_prompt": f"""{with_views('gsm')} SELECT example_id, 'Question: ' || question || chr(10)
        || 'Let''s think step by step.' || chr(10) || 'Answer:' AS prompt FROM gsm""",
    "gsm_extract": f"{with_views('gsm')} SELECT example_id, extracted_pred, extracted_target FROM ({GRADED})",
    "gsm_match": f"{with_views('gsm')} SELECT example_id, correct FROM ({GRADED})",
    "gsm_detail": f"{with_views('gsm')} SELECT * FROM ({GRADED})",
    "gsm_accuracy": f"""{with_views('gsm')} SELECT 'GSM8K' AS dataset, count(*) FILTER (correct) AS n_correct,
        count(*) AS n_total, count(*) FILTER (correct) / count(*)::DOUBLE AS accuracy FROM ({GRADED})""",
    "generator_pandas": f"""{with_views('gsm')} SELECT example_id, question, answer AS target,
        'So it is ' || trim(string_split(answer, '####')[2]) || '.' AS prediction,
        {number('answer')} || '.' AS extracted_pred, {number('answer')} AS extracted_target, true AS correct FROM gsm""",
    "generator_resumed": f"""{with_views('gsm')} SELECT example_id, CASE WHEN example_id % 2 = 0
        THEN 'So it is ' || trim(string_split(answer, '####')[2]) || '.' ELSE 'Nothing.' END AS prediction FROM gsm""",
    "pass_at_k": f"""SELECT user_id, n, c, CASE WHEN n < 3 THEN NULL WHEN n - c < 3 THEN 1.0
        ELSE round(1 - (n - c)::DOUBLE / n * (n - c - 1) / (n - 1) * (n - c - 2) / (n - 2), 6) END AS pass_at_k
        FROM ({PASS})""",
    "pass_at_1_mean": f"""SELECT count(*) AS n_tasks, round(avg(c / n::DOUBLE), 6) AS pass_at_k FROM ({PASS})""",
    "sample_fraction": """SELECT doc_id, text, lang, source, n_chars FROM (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, count(*) OVER () AS n FROM documents)
        WHERE r <= n - ceil(0.7::DOUBLE * n)""",
    "sample_cap": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS quantity, l_extendedprice
        FROM lineitem ORDER BY {several_keys('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'l_quantity::BIGINT')} LIMIT 5000""",
    "sample_cap_noop": "SELECT p_partkey, p_name FROM part ORDER BY md5('42:' || p_partkey) LIMIT 25000",
    "mixture_union": f"{MIXTURE} SELECT * FROM mixture",
    "mixture_counts": f"""{MIXTURE} SELECT coalesce(source, 'total') AS source, count(*) AS n_rows
        FROM mixture GROUP BY ROLLUP (source)""",
    "mixture_shuffle": f"""{MIXTURE} SELECT *,
        row_number() OVER (ORDER BY {several_keys('source', 'id')}, source, id) - 1 AS position FROM mixture""",
    "sft_labelled": f"""{with_views('arc', 'csqa')}
        SELECT 'science' AS source, * FROM ({LABELLED} FROM arc)
        UNION ALL SELECT 'commonsense', * FROM ({LABELLED} FROM csqa)""",
    "sft_positional": f"{with_views('mmlu')} SELECT example_id, prompt, target FROM ({POSITIONAL})",
    "sft_qa": f"{with_views('gsm')} SELECT example_id, question AS prompt, answer AS target FROM gsm",
    "sft_code": "SELECT page_id AS id, 'Write the page at ' || url AS prompt, html AS target FROM pages",
    "sft_rendered": f"""{with_views('arc')} SELECT example_id,
        {turn("'user'", 'prompt')} || {turn("'assistant'", 'target')} AS text FROM ({LABELLED} FROM arc)""",
    "dpo_pairs": f"{with_views('hella')} {PAIRS.format(table='hella')}",
    "dpo_pairs_wrapped": f"{with_views('hella', 'damaged')}, pairs AS ({PAIRS.format(table='damaged')}) {WRAPPED}",
    "preference_metrics": """SELECT l_returnflag, l_linestatus, count(*) AS n_pairs, round(avg(m), 5) AS margin,
        round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 5) AS loss,
        round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 5) AS accuracy
        FROM (SELECT l_returnflag, l_linestatus, 0.1::DOUBLE * ((-l_quantity - (-l_quantity - 20 * l_discount))
              - (-l_quantity * (1 + l_tax) - (-l_quantity - 30 * l_tax))) AS m FROM lineitem)
        GROUP BY l_returnflag, l_linestatus""",
    "chat_render": rendered("conversations", turn("role", "text")),
    "chat_render_prompted": rendered("conversations", turn("role", "text"), text(chat.ASSISTANT_OPEN)),
    "chat_render_batched": f"""{with_views('batches')} SELECT doc_id, item::INT AS item,
        {turn("'user'", 'substr(text, 1 + 2 * item * s, s)')}
        || {turn("'assistant'", 'substr(text, 1 + (2 * item + 1) * s, s)')} AS text FROM batches""",
    "chat_render_template": f"{with_views('turns')}, {TEMPLATE_PIECES} {rendered('template', 'piece')}",
    "chat_render_template_prompted": f"""{with_views('turns')}, {TEMPLATE_PIECES}
        {rendered('template', 'piece', text(chat.ASSISTANT_OPEN + chat.EMPTY_THINK))}""",
    "length_budget": f"""SELECT doc_id, len(w)::INT AS n_tokens, greatest(len(w) - 2048, 0)::INT AS n_cut,
        CASE WHEN len(w) <= 2048 THEN text ELSE left(text, ({first_words_end('2048')})::INT) END AS kept
        FROM (SELECT doc_id, text, {words('text')} AS w, string_split_regex(text, '\\S+') AS gaps FROM documents)""",
    "pair_budget": f"""{with_views('hella')}, pairs AS ({PAIRS.format(table='hella')}),
        sizes AS (SELECT example_id, len({words('prompt')})::INT AS n_prompt, len({words('chosen')})::INT AS n_chosen,
            len({words('rejected')})::INT AS n_rejected FROM pairs)
        SELECT *, least(n_prompt, 1024) AS kept_prompt, least(n_chosen, 2048 - least(n_prompt, 1024)) AS kept_chosen,
            least(n_rejected, 2048 - least(n_prompt, 1024)) AS kept_rejected FROM sizes""",
    "pair_cut": f"""{with_views('hella')}, pairs AS ({PAIRS.format(table='hella')}),
        sizes AS (SELECT *, {words_and_gaps('prompt')}, {words_and_gaps('chosen')}, {words_and_gaps('rejected')} FROM pairs),
        rooms AS (SELECT *, len(w_prompt) - 1024 AS cut, (2048 - least(len(w_prompt), 1024))::INT AS room FROM sizes)
        SELECT example_id, CASE WHEN cut <= 0 THEN prompt ELSE substr(prompt, 1 +
                ({first_words_end('cut', 'w_prompt', 'g_prompt', '(cut + 1)')})::INT) END AS prompt,
            {cut_start('chosen', 'room')}, {cut_start('rejected', 'room')} FROM rooms""",
    "bad_turns": f"""SELECT reason, sum(n)::BIGINT AS n_turns, count(*) AS n_conversations FROM (
        SELECT conv_id, CASE WHEN conv_id % 17 = 3 AND turn = 1 THEN '{chat.NO_ROLE}'
            WHEN (conv_id + turn) % 11 = 0 THEN '{chat.NO_TEXT}' END AS reason, count(*) AS n
        FROM conversations GROUP BY ALL) WHERE reason IS NOT NULL GROUP BY reason""",
    "length_report": f"""SELECT source, count(*) AS n_rows, sum(n)::BIGINT AS n_tokens,
        count(*) FILTER (n > 2048) AS rows_cut, sum(greatest(n - 2048, 0))::BIGINT AS tokens_cut
        FROM (SELECT source, len({words('text')}) AS n FROM documents) GROUP BY source""",
    "batch_plan": f"""SELECT *, position // 32 AS step, (position % 32) // 4 AS micro_batch FROM (
        SELECT doc_id, epoch::INT AS epoch,
            row_number() OVER (PARTITION BY epoch ORDER BY {several_keys('epoch', 'doc_id')}) - 1 AS position
        FROM documents, range(2) AS e(epoch))""",
    "cand_arc": f"{with_views('arc')} {CANDIDATES['arc']}",
    "cand_piqa": f"{with_views('piqa')} {CANDIDATES['piqa']}",
    "cand_mmlu": f"{with_views('mmlu')} {CANDIDATES['mmlu']}",
    "cand_hellaswag": f"{with_views('hella')} {CANDIDATES['hella']}",
    "cand_csqa": f"{with_views('csqa')} {CANDIDATES['csqa']}",
    "cand_winogrande": f"{with_views('wino')} {CANDIDATES['wino']}",
    "debug_head": f"""{with_views('arc')}, head AS (SELECT * FROM arc ORDER BY example_id LIMIT 5)
        {CANDIDATES['arc'].replace('FROM arc)', 'FROM head)')}""",
    "token_logprob": """WITH logits AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x,
        list_max(embedding)::DOUBLE AS top FROM embeddings)
        SELECT vec_id, round(x[1 + label] - top - ln(list_sum(list_transform(x, lambda v: exp(v - top)))), 6) AS lp
        FROM logits""",
    "cand_score_reference": f"""{with_views('logits', 'token_lp')}
        SELECT example_id, cand, round(score, 5) AS score FROM ({token_scores(0)})""",
    "cand_score_exact": f"""{with_views('logits', 'token_lp')}
        SELECT example_id, cand, round(score, 5) AS score FROM ({token_scores(1)})""",
    "token_predict": f"""{with_views('logits', 'token_lp', 'hella')}, scores AS ({token_scores(0)}),
        items AS ({CANDIDATES['hella']})
        SELECT example_id, label, cand AS prediction FROM (SELECT *, row_number() OVER (
            PARTITION BY example_id ORDER BY coalesce(round(score, 5), -9999.0) DESC, cand) AS r
            FROM items LEFT JOIN scores USING (example_id, cand)) WHERE r = 1""",
    "bigram_score": ONE_TASK_SCORES.format(
        views=with_views("hella"), candidates=CANDIDATES["hella"], scores=bigram_scores("reference")
    ),
    "bigram_score_exact": ONE_TASK_SCORES.format(
        views=with_views("mmlu"), candidates=CANDIDATES["mmlu"], scores=bigram_scores("exact")
    ),
    "scorer_pandas": f"""{with_views('hella')}, items AS (SELECT 'X' AS dataset, '' AS subset, * FROM
        ({CANDIDATES['hella']})), {vowel_predictions('items')} SELECT example_id, label, prediction FROM predicted""",
    "scorer_batched": f"""{with_views('hella')}, items AS (SELECT 'X' AS dataset, '' AS subset, * FROM
        ({CANDIDATES['hella']})), {vowel_predictions('items')} SELECT example_id, label, prediction FROM predicted""",
    "mc_predict": f"{BIGRAMS}, {PREDICTED} SELECT * FROM predicted",
    "mc_accuracy": f"{BIGRAMS}, {PREDICTED} SELECT dataset, {ACCURACY} FROM predicted GROUP BY dataset",
    "mc_accuracy_subject": f"""{BIGRAMS}, {PREDICTED} SELECT
        CASE WHEN subset <> '' THEN dataset || ' - ' || subset ELSE dataset END AS dataset, n_correct, n_total, accuracy
        FROM (SELECT dataset, subset, {ACCURACY} FROM predicted GROUP BY dataset, subset)""",
    "mc_accuracy_failed_left_out": f"""{with_views(*TASK_VIEWS)}, {ALL_CANDIDATES}, {vowel_predictions('items')}
        SELECT dataset, {ACCURACY} FROM predicted WHERE dataset <> 'HellaSwag' GROUP BY dataset""",
    "bad_rows": f"""{with_views('hella', 'damaged', 'mmlu')},
        problems AS (SELECT 'HellaSwag' AS dataset, CASE WHEN {LABEL_INDEX} IS NULL THEN 'label is not an integer'
            WHEN {LABEL_INDEX} < 0 OR {LABEL_INDEX} >= len(endings) THEN 'label is out of range'
            WHEN len(endings) < 2 THEN 'nothing to reject' END AS reason FROM damaged
        UNION ALL SELECT 'MMLU', CASE WHEN answer * 3 >= least(len(choices), 6) OR answer * 3 < -least(len(choices), 6)
            THEN 'answer has no letter' END FROM mmlu)
        SELECT dataset, reason, count(*) AS n_rows FROM problems WHERE reason IS NOT NULL GROUP BY dataset, reason""",
    "load_task_arrow": f"{with_views('arc')} SELECT label, context, cand, candidate FROM ({CANDIDATES['arc']})",
    "load_answers": f"{with_views('gsm')} SELECT question, answer FROM gsm WHERE example_id % 3 = 0",
    "evaluate_choices_job": f"""{with_views(*TASK_VIEWS, 'damaged')}, {ALL_CANDIDATES}, {vowel_predictions('items')}
        {SHOWN_ACCURACIES}
            FROM predicted WHERE dataset <> 'HellaSwag' GROUP BY ALL)
        UNION ALL SELECT 'HellaSwag', NULL, 'label is not an integer', count(*) FROM damaged WHERE {LABEL_INDEX} IS NULL""",
    "damaged_dataset_reported": f"""{with_views(*TASK_VIEWS)}, {ALL_CANDIDATES}, {vowel_predictions('items')},
        failing AS (SELECT subject, count(*) AS n FROM mmlu WHERE len(choices) > 4 GROUP BY subject)
        {SHOWN_ACCURACIES}
            FROM predicted WHERE dataset = 'ARC' OR dataset = 'MMLU' AND subset NOT IN (SELECT subject FROM failing)
            GROUP BY ALL)
        UNION ALL SELECT 'MMLU - ' || subject, NULL, 'scorer: RuntimeError', n FROM failing
        UNION ALL SELECT 'PIQA', NULL, 'DamagedFile', 1""",
    "training_rows": f"""{MIXTURE}, chats AS (SELECT {turn("'user'", 'prompt')} || {turn("'assistant'", 'target')} AS whole
            FROM mixture WHERE prompt IS NOT NULL AND target IS NOT NULL),
        sizes AS (SELECT whole, md5(whole) AS chat, {words_and_gaps('whole')} FROM chats),
        placed AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY {several_keys('epoch', 'chat')}) - 1 AS position
            FROM sizes, range(2) AS e(epoch))
        SELECT epoch::INT AS epoch, position, position // 32 AS step, (position % 32) // 4 AS micro_batch,
            {cut_start('whole', '20').replace('AS whole', 'AS text')}, len(w_whole)::INT AS n_tokens,
            greatest(len(w_whole) - 20, 0)::INT AS n_cut FROM placed""",
    "summary_text": f"""{with_views('mmlu', 'hella', 'answers', 'summary', 'shown_summary')}
        SELECT model, dataset, shown AS accuracy FROM shown_summary""",
    "summary_read": f"{with_views(*SUMMARY_VIEWS)} SELECT model, dataset, metric, value FROM read_summary",
    "leaderboard": f"{with_views(*SUMMARY_VIEWS)}, {board('read_summary')}",
    "leaderboard_pivot": f"""{with_views('mmlu', 'hella', 'answers', 'summary')},
        figures AS (SELECT model, dataset, 'Accuracy' AS metric, accuracy AS value FROM summary), {board('figures')}""",
    "detail_round_trip": f"{with_views('gsm')} SELECT 'baseline' AS model, * FROM ({GRADED})",
    "model_results_replaced": f"""{with_views('gsm')}, graded AS ({GRADED})
        SELECT model, example_id, correct FROM graded, (VALUES ('baseline'), ('SFT_LoRA')) m(model)
        WHERE correct OR model = 'SFT_LoRA'""",
    "latest_run": runs(True),
    "latest_final_run": runs(False),
    "resolve_split": resolved(["validation", "test", "train"], suffix=False, fallback=True),
    "resolve_suffix": resolved(["train"], suffix=True, fallback=False),
    "resolve_fallback": resolved(["test", "dev"], suffix=True, fallback=False),
    "resolve_any": resolved([], suffix=False, fallback=True),
    "split_files": f"""{with_views('files')}, marked AS (SELECT *, contains(regexp_extract(path, '[^/]*$'), 'train') AS hit,
        bool_or(contains(regexp_extract(path, '[^/]*$'), 'train')) OVER (PARTITION BY dataset, subset) AS any_hit
        FROM files WHERE path IS NOT NULL) SELECT dataset, subset, path FROM marked WHERE hit OR NOT any_hit""",
    "table_profile": profile(),
    "jsonl_round_trip": f"{MIXTURE} SELECT prompt, target FROM mixture",
    "pairs_round_trip": f"""{with_views('hella')}, pairs AS ({PAIRS.format(table='hella')})
        SELECT prompt, chosen, rejected FROM ({WRAPPED})""",
    "arrow_stream_scan": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "arrow_index_scan": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders,
        (SELECT max(o_orderkey) // 2 AS middle FROM orders) WHERE o_orderkey > middle AND o_orderkey <= middle + 2000""",
    "arrow_scan": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "write_once": "SELECT o_orderkey, o_custkey FROM orders",
    "missing_input_skipped": """SELECT coalesce(source, 'total') AS source, count(*) AS n_rows, 1 AS n_missing
        FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'part' FROM part) GROUP BY ROLLUP (source)""",
}
