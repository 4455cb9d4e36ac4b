"""Labelled findings and a random forest over them, written out as one SQL expression.

The findings are made by rule, bounded and reproducible: secrets and look-alikes in the contexts they come in.
Their features are computed by the same SQL as in the scan; only these few thousand rows reach the driver, where
the trees are grown.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters before and after a candidate that the forest sees.
BEFORE, AFTER = 48, 24
_KEY = r"(?i:passw(?:or)?d|passwd|passphrase|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|credentials?)"
_ASSIGNED = r"[\x22\x27]?\s{0,4}[:=]\s{0,4}"
_BLOCK = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: Looked for in this order at each place. Inside a word only a key block can begin; what is cheap to rule out comes first.
CANDIDATE = rf"-----BEGIN {_BLOCK}[^-]*+(?:-(?!----)[^-]*+){{0,64}}+-----END {_BLOCK}|(?<![A-Za-z0-9])(?:" + "|".join([
    r"eyJ(?<![_+/.-]eyJ)[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+",
    r"(?<=:)(?<=://[^\s:/@]{0,64}:)[^\s/@]++(?=@)",
    rf"(?<==)(?<=[?&]{_KEY}=)[^\s\x22\x27<>&#]++",
    rf"(?<=\x22)(?<={_KEY}{_ASSIGNED}\x22)[^\x22\n]++(?=\x22)",
    rf"(?<=\x27)(?<={_KEY}{_ASSIGNED}\x27)[^\x27\n]++(?=\x27)",
    rf"(?<=[:=\s])[^\s\x22\x27<>:=](?<=[:=]\s{{0,4}}.)(?<={_KEY}{_ASSIGNED}.)[^\s\x22\x27<>]*(?<![.,;:!?)])",
    r"(?=[A-Za-z0-9_+/-]{16})(?<![_+/-])(?![A-Za-z_][A-Za-z0-9_]*+=[A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+",
]) + ")"

#: What a text must hold to have a candidate, or one of MARKS: a digit with eight characters of a run on one side (a run of
#: 16 has that), or an assignment to a key word or the password's colon of an address. Far cheaper to look for, as such
#: places are rare, than candidates themselves.
TRIGGER = rf"[0-9:=](?:(?<=[0-9])(?:(?=[A-Za-z0-9_+/-]{{8}})|(?<=[A-Za-z0-9_+/-]{{9}}))|(?<={_KEY}[\x22\x27]?\s{{0,4}}[:=])|(?<=://[^\s:/@]{{0,64}}:))"
MARKS = ("eyJ", "-----BEGIN")

#: A vocabulary whose words serve as the dictionary: a line a token, base64 and rank.
VOCABULARY, RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 8_000
#: Words that the labelled findings are made of, besides those of the vocabulary.
NAMES = "access account admin archive article asset backup build cache catalog chapter client cloud commit config content course customer default design document download entry event example export field folder format gateway group handle header image import index input invoice item library list local login master media member module month network number object order output package page panel payment photo plan platform policy post price private process product profile project query random reader record release remote report request resource response result review route sample schema score screen script search section server service session setting shop sheet site source stage state storage store stream style submit summary support system table target task team template theme thread title topic track update upload user value version video view volume web week widget window writer year".split()
#: Common letter pairs of running text.
PAIRS = "th he in er an re on at en nd es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
#: Prefixes that issuers give their keys (fixed values).
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "glpat-", "-----BEGIN")

_KEYS = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api.?key|auth|bearer|credential|access.?key|private.?key)"
_BENIGN = r"(?i)(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|integrity|version|etag|order|invoice|isbn|phone|card|revision|blob|build|\bid)"

#: Features of a candidate @c with the text before it (@b) and after it (@a), as SQL.
FEATURES = {
    "len": "cast(length(@c) as double)",
    "digits": "regexp_count(@c, '[0-9]') / length(@c)",
    "only_digits": r"cast(@c rlike '^[0-9+/_=-]+$' as double)",
    "hex": r"cast(@c rlike '^([0-9a-f]+|[0-9A-F]+)$' as double)",
    "changes": "regexp_count(@c, '(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])') / length(@c)",
    "pairs": "regexp_count(lower(@c), '" + "|".join(PAIRS) + "') / length(@c)",
    "distinct": "size(array_distinct(split(@c, ''))) / length(@c)",
    "covered": "aggregate(filter(regexp_extract_all(@c, '[A-Z]?[a-z]+|[A-Z]+(?![a-z])', 0), r -> lower(r) in (@w)), 0, (n, r) -> n + length(r)) / length(@c)",
    "run": r"cast(@c rlike '(.)\\1{4,}' as double)",
    "slashes": "cast(regexp_count(@c, '/') + if(@b rlike '[/.]$', 1, 0) as double)",
    "extension": r"cast(@a rlike '^\\.[A-Za-z]{2,5}\\b' as double)",
    "parts": "cast(regexp_count(@c, '[_-]') as double)",
    "prefix": "cast(" + " or ".join(f"startswith(@c, '{p}')" for p in PREFIXES) + " as double)",
    "keyed": "cast(@b rlike '" + _KEYS.replace("\\", "\\\\") + r"\\W{0,12}$' as double)",
    "benign": "cast(@b rlike '" + _BENIGN.replace("\\", "\\\\") + r"\\W{0,12}$' as double)",
    "key_near": "cast(@b rlike '" + _KEYS.replace("\\", "\\\\") + "' as double)",
    "benign_near": "cast(@b rlike '" + _BENIGN.replace("\\", "\\\\") + "' as double)",
    "assigned": r"cast(@b rlike '[:=]\\s{0,4}[\"\\x27]?$' as double)",
    "login": r"cast(@b rlike '://[^\\s:/@]*:$' and startswith(@a, '@') as double)",
    "symbols": r"regexp_count(@c, '[^A-Za-z0-9]') / length(@c)",
    "quoted": r"cast(@b rlike '[\"\\x27]$' and @a rlike '^[\"\\x27]' as double)",
}

#: (label, before, candidate, after) as SQL over id, h (40 hex digits), s (44 base64 characters), n (16 digits), w and v (words).
_SHAPES = [
    (1, "concat(w, ' token = \"')", "h", "concat('\" ', v)"),
    (1, "concat(w, ' TOKEN = \"')", "upper(h)", "concat('\"!! ', v)"),
    (1, "concat(w, '\\ntoken: ')", "h", "concat(' ', v)"),
    (1, "'secret_key: \"'", "s", "'\"'"),
    (1, "concat('api_key=\\'')", "substr(h, 1, 32)", "'\\''"),
    (1, "'export API_KEY='", "substr(h, 5, 24)", "'\\n'"),
    (1, "concat(w, ' password: ')", "substr(s, 1, 20)", "concat('\\n', v)"),
    (1, "'Authorization: Bearer '", "concat('eyJ', translate(s, '+/', '-_'))", "' '"),
    (1, "concat(w, ' ')", "concat('AKIA', upper(translate(substr(h, 1, 16), '0189', 'WXYZ')), '7')", "concat(' ', v)"),
    (1, "concat('git clone with ', w, ' ')", "concat('ghp_', translate(substr(s, 1, 36), '+/', 'aZ'))", "concat(' ', v)"),
    (1, "'aws_secret_access_key = '", "substr(s, 1, 40)", "'\\n'"),
    (1, "concat(w, ' key \"')", "concat('sk_live_', translate(substr(s, 3, 24), '+/', 'bY'))", "concat('\" ', v)"),
    (1, "concat(w, ' ')", "concat('-----BEGIN PRIVATE KEY-----\\n', s, '\\n-----END PRIVATE KEY-----')", "concat(' ', v)"),
    (1, "concat('secret ')", "h", "concat(', ', v)"),
    (1, "concat(w, '\\npassword: ')", "concat(v, substr(n, 1, 1), substr(s, 1, 2), substr(n, 2, 2))", "concat('\\n', v)"),
    (1, "concat('my password = ')", "concat(substr(s, 1, 7), substr(n, 1, 1), '!', substr(n, 2, 2))", "concat(' ', v)"),
    (1, "'password: '", "concat(v, substr(n, 1, 2), w, substr(n, 3, 2))", "''"),
    (1, "'\\nDB_PASSWORD='", "concat(substr(translate(s, '+/', 'aZ'), 1, 9), substr(n, 1, 1))", "'\\nDB_HOST=db'"),
    (1, "concat('postgres://', w, ':')", "concat(substr(translate(s, '+/', 'aZ'), 1, 12), substr(n, 1, 1))", "'@host/db '"),
    (1, "concat(v, ' mysql://u:')", "concat(v, substr(n, 1, 2))", "'@h:3306/db'"),
    (1, "concat('https://api.example.org/', w, '?token=')", "substr(h, 1, 24)", "'&page=2'"),
    (1, "concat('https://example.org/', w, '?x=1&api_key=')", "substr(h, 1, 32)", "' '"),
    (1, "'MY_SECRET_TOKEN='", "h", "'\\n'"),
    (1, "concat(w, ' ')", "concat('eyJhbGciOiJIUzI1NiJ9.eyJ', translate(s, '+/', '-_'), '.', translate(s, '+/', '-_'))", "concat(' ', v)"),
    (1, "concat(w, '\\n')", "concat('-----BEGIN RSA PRIVATE KEY-----\\nProc-Type: 4,ENCRYPTED\\nDEK-Info: AES-128-CBC,', upper(substr(h, 1, 32)), '\\n\\n', s, '\\n', s, '\\n-----END RSA PRIVATE KEY-----')", "concat('\\n', v)"),
    (1, "concat(w, '\\n')", "concat('-----BEGIN PGP PRIVATE KEY BLOCK-----\\nVersion: GnuPG v2\\n\\n', s, '\\n=', substr(s, 1, 4), '\\n-----END PGP PRIVATE KEY BLOCK-----')", "concat('\\n', v)"),
    (0, "concat(w, ' password: ')", "v", "concat(' ', w)"),
    (0, "concat(w, ' token: ')", "v", "concat(' ', w)"),
    (0, "'secret = '", "concat('get_', v, '(')", "')'"),
    (0, "'api_key = '", "concat('config.', v)", "'\\n'"),
    (0, "'token = \"'", "v", "'\"'"),
    (0, "'PASSWORD='", "concat('${', upper(v), '}')", "'\\n'"),
    (0, "'https://example.org/?token='", "v", "'&page=2'"),
    (0, "concat('COMMIT_ID=')", "h", "'\\n'"),
    (0, "'https://example.org/?id='", "substr(h, 1, 32)", "'&page=2'"),
    (0, "concat(w, ' ')", "n", "concat(' ', v)"),
    (0, "concat(w, ' ')", "n", "concat('!! ', v)"),
    (0, "concat('card ')", "n", "concat('. ', v)"),
    (0, "concat('commit ')", "h", "concat('\\n', v)"),
    (0, "concat(w, ' sha1: ')", "h", "concat(' ', v)"),
    (0, "concat(w, ' ')", "h", "concat(' ', v)"),
    (0, "'see '", "concat('/objects/', substr(h, 1, 2), '/', substr(h, 3))", "' '"),
    (0, "'file '", "concat(w, '/', v, '/', substr(h, 1, 12))", "'.png '"),
    (0, "'integrity: \"'", "concat('sha512-', s)", "'\"'"),
    (0, "'id: '", "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 12))", "' '"),
    (0, "'uuid = \"'", "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 12))", "'\"'"),
    (0, "'checksum '", "substr(h, 1, 32)", "concat(' ', v)"),
    (0, "'https://www.example.org'", "concat('/', w, '/2024/', v, '-report-final')", "' '"),
    (0, "concat(w, ' ')", "concat('getElementBy', initcap(v), 'Number', substr(n, 1, 1))", "'('"),
    (0, "concat(w, ' ')", "concat('IMG_2024', substr(n, 1, 4), '_', substr(n, 5, 6))", "'.jpg'"),
    (0, "'token_type = \"'", "concat(v, '-', w, '-example-', substr(n, 1, 2))", "'\"'"),
    (0, "'password: '", "'xxxxxxxxxxxxxxx1'", "' '"),
    (0, "concat('order ')", "concat('INV-2024-', n)", "concat(' ', v)"),
    (0, "concat('version = ')", "concat('release-', substr(n, 1, 2), '-', substr(n, 3, 2), '-', substr(n, 5, 6))", "' '"),
    (0, "'isbn: '", "concat('978', substr(n, 1, 10), '-', substr(n, 2, 4))", "' '"),
    (0, "concat(w, ' auth ')", "concat(w, '-', v, '-service-module-', substr(n, 1, 3))", "' '"),
    (1, "concat('CLIENT_', upper(w), '_SECRET: ')", "translate(substr(s, 2, 32), '+/', 'xQ')", "concat('\\n', v)"),
    (1, "concat('curl -u ', w, ' -H \"X-Auth-Token: ')", "substr(h, 3, 32)", "'\" '"),
    (1, "concat('{\"', w, '_password\": \"')", "concat(substr(translate(s, '+/', '#!'), 1, 14), substr(n, 1, 1))", "'\"}'"),
    (1, "'slack '", "concat('xoxb-', substr(n, 1, 11), '-', translate(substr(s, 1, 24), '+/', 'aZ'))", "concat(' ', v)"),
    (1, "concat(w, ' pwd=')", "concat(substr(translate(s, '+/', '@$'), 1, 10), substr(n, 3, 2))", "concat('; ', v)"),
    (1, "concat('the private key ', w, ': ')", "substr(h, 1, 40)", "concat(' ', v)"),
    (1, "concat('ftp://', w, ':')", "concat(w, substr(n, 1, 3), '!', substr(s, 1, 3))", "'@files.example.org/'"),
    (0, "concat('see https://example.org/', w, '/')", "concat('blob/', substr(h, 1, 40))", "concat('/', v, '.md')"),
    (0, "concat('src=\"')", "concat('/static/', w, '/', v, '.', substr(h, 1, 8))", "'.js\"'"),
    (0, "'image: app@sha256:'", "concat(h, substr(h, 1, 24))", "concat('\\n', v)"),
    (0, "concat('cp ')", "concat('/var/', w, '/', v, '/', substr(n, 1, 8), '/', w)", "'.tar.gz '"),
    (0, "concat('import ')", "concat(w, '_', v, '_', w, '_v', substr(n, 1, 1))", "' as x'"),
    (0, "concat(w, ' = new ')", "concat(initcap(w), initcap(v), 'Factory', initcap(w), substr(n, 1, 1))", "'()'"),
    (0, "concat('class=\"')", "concat(w, '-', v, '--', w, '-col-', substr(n, 1, 2))", "'\"'"),
    (0, "concat('tel ')", "concat('+', substr(n, 1, 4), '-', substr(n, 5, 4), '-', substr(n, 9, 6))", "concat(' ', v)"),
    (0, "concat('date ')", "concat('2024-', substr(n, 1, 2), '-', substr(n, 3, 2), 'T', substr(n, 5, 6), '+0000')", "concat(' ', v)"),
    (0, "concat('token: ')", "concat('XXXXXXXXXXXX', substr(n, 1, 4))", "concat(' ', v)"),
    (0, "concat('api_key = \"')", "concat('your-', v, '-key-here')", "'\"'"),
    (0, "concat('password=')", "concat('0000000000', substr(n, 1, 1))", "' '"),
    (0, "concat('tree ')", "concat(substr(h, 1, 2), '/', substr(h, 3, 2), '/', substr(h, 5, 36))", "concat(' ', v)"),
    (0, "concat('doi 10.1000/')", "concat(w, '.', substr(n, 1, 4), '.', substr(n, 5, 6), '/', v, '-', substr(n, 1, 4))", "concat(' ', v)"),
    (0, "concat('integrity=\"')", "concat('sha384-', s, substr(s, 1, 20))", "'\" crossorigin'"),
    (0, "concat('fingerprint ')", "concat('SHA256/', s)", "concat('\\n', v)"),
    (0, "concat('ETag: \"')", "concat(substr(h, 1, 32), '-', substr(n, 1, 2))", "'\"'"),
]


@lru_cache
def dictionary(path: str = VOCABULARY, ranks: int = RANKS) -> tuple[str, ...]:
    """The words of four letters and more among the vocabulary's first ranks: tokens that begin a word and are all letters."""
    words = set()
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            if int(rank) < ranks and (word := re.fullmatch(b" ([A-Z]?[a-z]{3,})", base64.b64decode(token))) and len(word[1]) > 3:
                words.add(word[1].decode().lower())
    return tuple(sorted(words))


def features_sql(of: str = "", words: tuple[str, ...] | None = None) -> dict[str, str]:
    """The features with a, b and c as columns, or as fields of a struct `of`; words: the dictionary, or the vocabulary's."""
    known = ", ".join(f"'{w}'" for w in (words or dictionary()))
    return {name: f"cast({sql.replace('@w', known).replace('@', of)} as double)" for name, sql in FEATURES.items()}


def labelled_findings(spark: SparkSession, each: int = 120, shapes: list[int] | None = None, first: int = 0) -> DataFrame:
    """each texts of every shape (or of these only), split as the scan splits: a row (shape, b, c, a, label) for each
    candidate in its finding. Texts are made from numbers from `first` on: other numbers, other texts."""
    chosen = list(range(len(_SHAPES))) if shapes is None else shapes
    words = "array(" + ", ".join(f"'{w}'" for w in NAMES) + ")"
    of = lambda part: f"case id % {len(chosen)} " + " ".join(f"when {i} then {_SHAPES[k][part]}" for i, k in enumerate(chosen)) + " end"
    start = first * len(chosen)
    word = lambda seed: f"element_at({words}, cast(pmod(xxhash64(id, {seed}), {len(NAMES)}) + 1 as int))"
    base = spark.range(start, start + each * len(chosen)).selectExpr("id", "sha1(cast(id as string)) h", "substr(base64(unhex(sha2(cast(id as string), 256))), 1, 43) s", "substr(translate(sha2(concat('n', id), 256), 'abcdef', '318064'), 1, 16) n", f"{word(0)} w", f"{word(1)} v")
    texts = base.selectExpr(f"element_at(array({', '.join(map(str, chosen))}), cast(id % {len(chosen)} + 1 as int)) shape", f"concat({of(1)}, {of(2)}, {of(3)}) text", f"{of(2)} finding", f"cast({of(0)} as double) label")
    # bounded by each x shapes; made rows again, or Spark would write the shapes' rules out for every later use of a text
    texts = spark.createDataFrame(texts.collect(), texts.schema)
    texts = texts.withColumn("cands", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("parts", F.split("text", CANDIDATE, -1))
    rows = texts.where(F.size("cands") > 0).selectExpr("shape", "finding", "label", f"inline(transform(cands, (c, i) -> named_struct('b', right(parts[i], {BEFORE}), 'c', c, 'a', left(parts[i + 1], {AFTER}))))")
    return rows.where("contains(finding, c) or contains(c, finding)").select("shape", "b", "c", "a", "label")


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tried: int, least: int) -> tuple | float:
    """Nested (feature, threshold, below or at, above), or the share of secrets in a leaf."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return round(share, 4)
    best = (1e-9, None)
    for j in rng.permutation(x.shape[1])[:tried]:
        values = np.unique(x[:, j])
        for t in (values[:-1] + values[1:])[:: max(1, len(values) // 24)] / 2:
            low = x[:, j] <= t
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            gain = share * (1 - share) - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
            if gain > best[0]:
                best = (gain, (int(j), float(t), low))
    if best[1] is None:
        return round(share, 4)
    j, t, low = best[1]
    return j, t, _tree(x[low], y[low], rng, depth - 1, tried, least), _tree(x[~low], y[~low], rng, depth - 1, tried, least)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 5) -> list:
    rng = np.random.default_rng(seed)
    picks = [rng.integers(0, len(x), len(x)) for _ in range(trees)]
    return [_tree(x[p], y[p], rng, depth, 6, 4) for p in picks]


def predict(forest: list, x: np.ndarray) -> np.ndarray:
    """The forest's vote for each row, walked in plain Python (for tests of the SQL)."""

    def one(node: tuple | float, row: np.ndarray) -> float:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return np.array([np.mean([one(t, row) for t in forest]) for row in x])


def as_sql(forest: list, f: str = "f") -> str:
    """The forest's vote over a struct named f with the features, as one expression."""
    names = list(FEATURES)

    def node(t: tuple | float) -> str:
        return f"if({f}.{names[t[0]]} <= {t[1]!r}D, {node(t[2])}, {node(t[3])})" if isinstance(t, tuple) else f"{t!r}D"

    return "(" + " + ".join(node(t) for t in forest) + f") / {len(forest)}D"


def fit_forest(spark: SparkSession, each: int = 120, shapes: list[int] | None = None) -> list:
    """The forest over `each` findings of every shape (or of these only)."""
    rows = labelled_findings(spark, each, shapes).selectExpr("label", *[f"{sql} as {name}" for name, sql in features_sql().items()]).collect()
    data = np.array([list(r) for r in rows])
    return grow(data[:, 1:], data[:, 0])
