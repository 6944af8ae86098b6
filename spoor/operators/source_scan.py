"""Scanners over source files: defensive patterns, tools, state keys, framework definitions.

A file is one row. Its lines stay an array in that row, and context (lines nearby, enclosing
scope, block ends) is read from the array with higher-order functions, so a scan needs no
shuffle and only the matches leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions.stats import count_if

# fixed values: regular expressions by category
DELEGATION = [r"\.kickoff\(", r"\.invoke\(", r"agent\.run\(", r"run_agent\(", r"\.execute\(", r"graph\.stream\(", r"initiate_chat\(", r"\.send\(", r"crew\.kickoff\("]
TIMEOUTS = [("timeout", r"timeout\s*=\s*(\d+)"), ("max_retries", r"max_retries\s*=\s*(\d+)"), ("max_iterations", r"max_iterations?\s*=\s*(\d+)"), ("recursion_limit", r"recursion_limit\s*=\s*(\d+)"),
            ("max_rpm", r"max_rpm\s*=\s*(\d+)"), ("max_execution_time", r"max_execution_time\s*=\s*(\d+)")]
VALIDATION = [("pydantic_model", r"class\s+(\w+)\(BaseModel\)"), ("typed_dict", r"class\s+(\w+)\(TypedDict\)"), ("crewai_output_pydantic", r"output_pydantic\s*="), ("crewai_output_json", r"output_json\s*="),
              ("json_parse", r"json\.loads\("), ("json_schema", r"jsonschema\.validate\("), ("regex_validation", r"re\.(match|search|fullmatch)\("), ("pydantic_v2_validate", r"\.model_validate\("),
              ("pydantic_v1_validate", r"\.parse_obj\("), ("langchain_structured", r"StructuredOutput")]
CONCURRENCY = [("lock", r"threading\.Lock\(\)"), ("rlock", r"threading\.RLock\(\)"), ("async_lock", r"asyncio\.Lock\(\)"), ("semaphore", r"Semaphore\("), ("queue", r"Queue\("), ("acquire", r"\.acquire\(\)"),
               ("release", r"\.release\(\)"), ("atomic_reference", r"atomic")]
RATE_LIMIT = [("sleep", r"time\.sleep\("), ("backoff_decorator", r"backoff\."), ("retry_decorator", r"@retry"), ("tenacity", r"tenacity\."), ("exponential_backoff", r"exponential_backoff"),
              ("rate_limit_reference", r"rate_limit"), ("rate_limiter_class", r"RateLimiter")]
SANITIZE = [("strip", r"\.strip\(\)"), ("replace", r"\.replace\("), ("html_escape", r"html\.escape\("), ("sanitize_reference", r"sanitize"), ("validate_input", r"validate_input"), ("clean_function", r"clean_"),
            ("type_assertion", r"assert\s+isinstance\("), ("type_check", r"if\s+not\s+isinstance\(")]
PROMPT = [("role_boundary", r"(?i)you are ONLY responsible for"), ("prohibition", r"(?i)do NOT"), ("prohibition", r"(?i)you must NOT"), ("prohibition", r"(?i)never\s+(attempt|try|generate|fabricate)"),
          ("output_format", r"(?i)output.*format"), ("structured_output_requirement", r"(?i)respond.*JSON"), ("confidence_requirement", r"(?i)confidence.*level"), ("uncertainty_instruction", r"(?i)if.*unsure.*say"),
          ("attribution_requirement", r"(?i)cite.*source"), ("anti_assumption", r"(?i)do not.*assume")]
TRY, EXCEPT = r"^\s*try\s*:", r"^\s*except\s*(.*?)\s*:"
FRAMEWORKS = {
    "crewai": [r"from\s+crewai\s+import", r"import\s+crewai", r"Agent\s*\(", r"\.kickoff\s*\("],
    "langgraph": [r"from\s+langgraph", r"StateGraph\s*\(", r"\.add_node\s*\(", r"\.compile\s*\("],
    "autogen": [r"from\s+autogen", r"ConversableAgent\s*\(", r"AssistantAgent\s*\(", r"GroupChat\s*\("],
    "openai": [r"openai\.OpenAI\s*\(", r"client\.chat\.completions\.create", r"from\s+openai\s+import"],
}
METHODS = ["get", "set", "update", "pop", "keys", "values", "items", "copy", "clear", "__init__"]

MATCH = "struct<line_number:int,category:string,kind:string,value:bigint,near_boundary:boolean,flag:boolean,text:string>"


def lines_of(content: Column) -> Column:
    return F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")


def _any(line: Column, patterns: list[str]) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in patterns))


def _matching(pattern: str):
    return lambda line: line.rlike(pattern)


def _around(arr: Column, i: Column, before: int, after: int) -> Column:
    """Elements i-before .. i+after of an array (0-based i)."""
    start = F.greatest(i - before, F.lit(0))
    return F.slice(arr, start + 1, i + after - start + 1)


def in_string(prefix: Column) -> Column:
    """Is the position after `prefix` inside a quoted literal? Triple quotes toggle first, then single ones."""
    no_triple = F.regexp_replace(prefix, "\"\"\"|'''", "")
    triples = F.size(F.split(prefix, "\"\"\"|'''")) - 1
    state = F.aggregate(F.split(no_triple, ""), F.lit(""), lambda s, c: F.when((s == "") & c.isin('"', "'"), c).when((s != "") & (c == s), F.lit("")).otherwise(s))
    return (triples % 2 == 1) | (state != "")


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def timeout_class(value: Column) -> Column:
    return F.when(value <= 120, "effective").when(value <= 300, "weak").otherwise("ineffective")


LINE_RULES = [(c, k, rx) for c, rules in (("timeout_iteration_guards", TIMEOUTS), ("output_validation", VALIDATION), ("concurrency_controls", CONCURRENCY), ("rate_limiting_backoff", RATE_LIMIT), ("input_sanitization", SANITIZE), ("prompt_constraints", PROMPT)) for k, rx in rules]
# what a category looks for around its match: (pattern, lines before, lines after)
NEARBY = {"concurrency_controls": (r"global\s+\w|cls\.\w|self\.\w+\s*=", 10, 9), "rate_limiting_backoff": (r"requests\.|httpx\.|aiohttp\.", 10, 9), "input_sanitization": (r"^\s*def\s+\w+\(", 20, -1), "prompt_constraints": (r"(?i)system_prompt|system_message|SystemMessage", 5, 0)}
LOGGING = r"logging\.(error|warning|info|exception)|print\("
_OPEN = "array<struct<at:int,depth:int,kind:string,size:int,logs:boolean>>"


def handlers(lines: Column) -> Column:
    """Exception handlers of a file by one pass over its lines: place, depth, kind, lines in their body, whether these log.

    A stack of indentation holds the lines that may own a handler (neither blank, comment nor handler): the nearest at
    most as deep must open a try. Open handlers wait beside it until a line at most as deep as they are ends their body.
    """
    def look(x, i):
        clause = F.trim(F.regexp_replace(F.regexp_extract(x, EXCEPT, 1), r"\s+as\s+\w+", ""))
        names = F.transform(F.split(clause, ","), lambda n: F.trim(n))
        kind = F.when(clause == "", "bare").when(F.arrays_overlap(names, F.array(F.lit("Exception"), F.lit("BaseException"))), "broad").otherwise("specific")
        plain = F.ltrim(x)
        return F.struct(
            i.cast("int").alias("at"), _indent(x).alias("depth"), (plain == "").alias("blank"), plain.startswith("#").alias("comment"), F.when(x.rlike(EXCEPT), kind).alias("kind"), x.rlike(TRY).alias("opens"), x.rlike(LOGGING).alias("logs"))

    def step(s, x):
        owner = F.coalesce(F.try_element_at(F.filter(s["stack"], lambda b: b["depth"] <= x["depth"]), F.lit(-1))["opens"], F.lit(False))
        ended = F.filter(s["open"], lambda h: h["depth"] >= x["depth"])
        inside = F.transform(F.filter(s["open"], lambda h: h["depth"] < x["depth"]), lambda h: F.struct(h["at"].alias("at"), h["depth"].alias("depth"), h["kind"].alias("kind"), (h["size"] + 1).alias("size"), (h["logs"] | x["logs"]).alias("logs")))
        new = F.array(F.struct(x["at"].alias("at"), x["depth"].alias("depth"), x["kind"].alias("kind"), F.lit(0).alias("size"), F.lit(False).alias("logs")))
        open_ = F.when(x["kind"].isNotNull() & owner, F.concat(inside, new)).otherwise(inside)
        block = F.concat(F.filter(s["stack"], lambda b: b["depth"] < x["depth"]), F.array(F.struct(x["depth"].alias("depth"), x["opens"].alias("opens"))))
        stack = F.when(x["comment"] | x["kind"].isNotNull(), s["stack"]).otherwise(block)
        moved = F.struct(stack.alias("stack"), open_.cast(_OPEN).alias("open"), F.when(F.size(ended) > 0, F.concat(s["done"], ended)).otherwise(s["done"]).alias("done"))
        return F.when(x["blank"], s).otherwise(moved)

    start = F.struct(F.array().cast("array<struct<depth:int,opens:boolean>>").alias("stack"), F.array().cast(_OPEN).alias("open"), F.array().cast(_OPEN).alias("done"))
    return F.aggregate(F.transform(lines, look), start, step, lambda s: F.concat(s["done"], s["open"]))


def scan_patterns(files: DataFrame) -> DataFrame:
    """files(repo_id, path, content) -> one row per defensive pattern found.

    `flag` is the category's own context: near shared state, near an API call, exponential,
    from a function's parameters, or in a system prompt. `text` is the whole line without its indentation.
    A rule is first tried on the whole text of a file; the lines are tried only with rules that occur in it.
    """
    whole = [F.col("content").rlike(f"(?m){rx}") for _, _, rx in LINE_RULES]
    lines = lines_of(F.col("content"))
    calls = F.when(_any(F.col("content"), DELEGATION), F.transform(lines, lambda x: _any(x, DELEGATION)))
    seen = F.array(*whole, F.col("content").rlike(f"(?m){EXCEPT}"))
    # One-element explode: the optimizer would otherwise copy these expressions into every use, once a line.
    once = F.explode(F.array(F.struct(lines.alias("L"), seen.alias("H"), F.coalesce(calls, F.array().cast("array<boolean>")).alias("D"))))
    d = files.select("repo_id", "path", once.alias("f")).select("repo_id", "path", "f.*").filter(F.exists("H", lambda h: h))

    def row(i, category, kind, flag, line, value):
        near = F.exists(_around(F.col("D"), i, 10, 10), lambda b: b)
        return F.struct(
            (i + 1).cast("int").alias("line_number"), F.lit(category).alias("category"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.cast("bigint").alias("value"), near.alias("near_boundary"), flag.alias("flag"), F.trim(line).alias("text"))

    def matches(n: int, category: str, kind: str, rx: str) -> Column:
        def at(x, i):
            found, flag, value = x.rlike(rx), F.lit(False), F.lit(None)
            if category in NEARBY:
                around, before, after = NEARBY[category]
                flag = F.exists(_around(F.col("L"), i, before, after), _matching(around))
            if category == "timeout_iteration_guards":
                value = F.regexp_extract(x, rx, 1).try_cast("bigint")
            if category == "prompt_constraints":
                found = found & in_string(F.get(F.split(x, rx, 2), 0))
            return F.when(found, row(i, category, kind, flag, x, value))

        return F.when(F.col("H")[n], F.array_compact(F.transform("L", at)))

    per_rule = [matches(n, *rule) for n, rule in enumerate(LINE_RULES)]
    caught = F.transform(F.when(F.col("H")[len(LINE_RULES)], handlers(F.col("L"))), lambda h: row(h["at"], "exception_handling_topology", h["kind"], h["logs"], F.get("L", h["at"]), h["size"]))
    none = F.array().cast(f"array<{MATCH}>")
    return d.select("repo_id", "path", F.explode(F.concat(*[F.coalesce(m, none) for m in (*per_rule, caught)])).alias("m")).select("repo_id", "path", "m.*")


def pattern_summary(patterns: DataFrame) -> DataFrame:
    """Counts per repository and category with the sub-features used for remediation."""
    c, k = F.col("category"), F.col("kind")
    return patterns.groupBy("repo_id", "category").agg(
        F.count(F.lit(1)).alias("count"), count_if(F.col("near_boundary")).alias("near_boundary_count"), count_if((c == "timeout_iteration_guards") & (F.col("value") <= 120)).alias("effective_count"),
        count_if((c == "exception_handling_topology") & F.col("flag")).alias("has_logging_count"), count_if((c == "exception_handling_topology") & (k == "bare")).alias("bare_except_count"),
        count_if(k.isin("pydantic_model", "pydantic_v2_validate", "pydantic_v1_validate")).alias("pydantic_count"), count_if(k == "role_boundary").alias("role_boundary_count"),
        count_if(k == "prohibition").alias("prohibition_count"), count_if(k == "uncertainty_instruction").alias("uncertainty_instruction_count"))


def delegation_lines(files: DataFrame) -> DataFrame:
    lines = F.transform(lines_of(F.col("content")), lambda x, i: F.struct((i + 1).alias("line_number"), F.trim(x).alias("text"), _any(x, DELEGATION).alias("hit")))
    return files.select("repo_id", "path", F.explode(F.filter(lines, lambda s: s["hit"])).alias("s")).select("repo_id", "path", "s.line_number", "s.text")


def tool_registrations(files: DataFrame) -> DataFrame:
    """(repo_id, path, scope, tool): tools by decorator, constructor, list, server or client call."""
    d = files.select("repo_id", "path", lines_of(F.col("content")).alias("L"))
    scope_of = lambda x: F.coalesce(F.when(x.rlike(r"^class\s+(\w+)"), F.regexp_extract(x, r"^class\s+(\w+)", 1)), F.when(x.rlike(r"(\w+)\s*=\s*(?:Agent|CrewAgent|ChatAgent)\s*\("), F.regexp_extract(x, r"(\w+)\s*=\s*(?:Agent|CrewAgent|ChatAgent)\s*\(", 1)))
    d = d.withColumn("S", F.transform("L", scope_of))

    def tools(x, i):
        scope = F.coalesce(F.try_element_at(F.filter(F.slice("S", 1, i + 1), lambda s: s.isNotNull()), F.lit(-1)), F.lit("unattributed"))
        ahead = F.get(F.filter(F.transform(F.slice("L", i + 2, F.lit(3)), lambda y: F.regexp_extract(y, r"def\s+(\w+)\s*\(", 1)), lambda n: n != ""), F.lit(0))
        cap = lambda rx, g=1: F.when(x.rlike(rx), F.regexp_extract(x, rx, g))
        structured = r"StructuredTool(?:\.from_function)?\(\s*(?:func\s*=\s*(\w+)|name\s*=\s*[\"'](\w+)[\"'])"
        listed = F.filter(F.regexp_extract_all(F.regexp_extract(x, r"tools\s*=\s*\[([^\]]+)\]", 1), F.lit(r"(\w+)"), F.lit(1)), lambda n: n.rlike("^[a-z]"))
        single = F.array_compact(F.array(
            F.when(x.rlike(r"@tool\b|(?:mcp|server)\.tool\(\)"), ahead), cap(r"Tool\(\s*name\s*=\s*[\"'](\w+)[\"']"), F.when(x.rlike(structured), F.coalesce(F.nullif(F.regexp_extract(x, structured, 1), F.lit("")), F.regexp_extract(x, structured, 2))),
            F.when(x.rlike(r"(?:requests|httpx)\.\s*(?:get|post|put|patch|delete)\s*\("), F.lit("http_client")), F.when(x.rlike(r"cursor\.execute|session\.query|\.find\(|\.aggregate\("), F.lit("database_query")),
            F.when(x.rlike(r"open\([^)]*[\"']w|Path\([^)]*\.write"), F.lit("file_write"))))
        return F.transform(F.concat(listed, single), lambda t: F.struct(scope.alias("scope"), t.alias("tool")))

    return d.select("repo_id", "path", F.explode(F.flatten(F.transform("L", tools))).alias("t")).select("repo_id", "path", "t.scope", "t.tool").distinct()


def state_keys(files: DataFrame) -> DataFrame:
    """(repo_id, key): state keys by index, attribute, or field of a typed state class."""
    d = files.select("repo_id", lines_of(F.col("content")).alias("L"), "content")
    head = F.transform("L", lambda x: F.when(x.rlike(r"class\s+\w+\((TypedDict|BaseModel)\)"), F.lit("in")).when((F.trim(x) != "") & ~x.rlike(r"^[ \t]"), F.lit("out")))
    d = d.withColumn("H", head)
    fields = F.transform("L", lambda x, i: F.when((F.try_element_at(F.filter(F.slice("H", 1, i), lambda h: h.isNotNull()), F.lit(-1)) == "in") & x.rlike(r"^\s+(\w+)\s*:\s*\w+"), F.regexp_extract(x, r"^\s+(\w+)\s*:\s*\w+", 1)))
    index = F.regexp_extract_all("content", F.lit(r"state\s*\[\s*[\"'](\w+)[\"']\s*\]"), F.lit(1))
    attr = F.filter(F.regexp_extract_all("content", F.lit(r"state\.(\w+)\b"), F.lit(1)), lambda a: ~a.isin(METHODS))
    return d.select("repo_id", F.explode(F.array_distinct(F.concat(F.array_compact(fields), index, attr))).alias("key")).distinct()


def framework_hits(files: DataFrame) -> DataFrame:
    """(repo_id, framework, hits): files that match each framework expression, test files left out."""
    plain = files.filter(~F.lower("path").rlike(r"(^|/)tests?/|test_|_test\.py"))
    pairs = F.array_compact(F.array(*[F.when(F.col("content").rlike(rx), F.lit(f)) for f, rxs in FRAMEWORKS.items() for rx in rxs]))
    return plain.select("repo_id", F.explode(pairs).alias("framework")).groupBy("repo_id", "framework").agg(F.count(F.lit(1)).alias("hits"))


def agent_roles(content: Column) -> Column:
    """Distinct role values of Agent(...) calls in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"(?s)Agent\s*\([^)]*role\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)), lambda r: F.trim(r)), lambda r: r != ""))


# fixed values: (framework, variant, texts of which one occurs as written, texts of which one occurs in any case, roles at least);
# the first rule of a framework that holds names its variant, an empty list asks for nothing
VARIANT_RULES = [
    ("crewai", "delegation", [], ["allow_delegation", "delegation"], 0), ("crewai", "tooled", ["@tool", "BaseTool"], ["tool"], 0), ("crewai", "reviewed", [], [], 3), ("crewai", "delegation", [], [], 0),
    ("langgraph", "conditional", [], ["conditional"], 0), ("langgraph", "branching", [], [], 0), ("autogen", "groupchat", ["GroupChat"], [], 0), ("autogen", "twoway", [], [], 0),
]


def variant(content: Column, framework: Column) -> Column:
    """Topology variant of a source text by the rules of its framework; 'delegation' for other frameworks."""
    out = F.lit("delegation")
    for owner, name, exact, any_case, roles in reversed(VARIANT_RULES):
        holds = framework == owner
        for words, text in ((exact, content), (any_case, F.lower(content))):
            holds = holds & text.rlike("|".join(words)) if words else holds
        out = F.when(holds & (F.size(agent_roles(content)) >= roles) if roles else holds, name).otherwise(out)
    return out


def string_param(block: Column, name: str) -> Column:
    """A string argument in any of six quoting styles; placeholders become a neutral word."""
    styles = [rf'(?s){name}\s*=\s*"""(.*?)"""', rf"(?s){name}\s*=\s*'''(.*?)'''", rf'(?s){name}\s*=\s*f"([^"]*)"', rf"(?s){name}\s*=\s*f'([^']*)'", rf'(?s){name}\s*=\s*"((?:[^"\\]|\\.)*)"', rf"(?s){name}\s*=\s*'((?:[^'\\]|\\.)*)'"]
    found = F.coalesce(*[F.when(block.rlike(s), F.regexp_extract(block, s, 1)) for s in styles], F.lit(""))
    return F.regexp_replace(F.trim(found), r"\{[^}]+\}", "example")


def definitions(files: DataFrame, call: str, params: list[str], required: str) -> DataFrame:
    """Call blocks such as Agent(...) or Task(...) with the named string arguments."""
    blocks = F.regexp_extract_all("content", F.lit(rf"(?s){call}\s*\(([^)]*(?:\([^)]*\)[^)]*)*)\)"), F.lit(1))
    d = files.select("repo_id", "path", F.explode(blocks).alias("b"))
    return d.select("repo_id", "path", *[string_param(F.col("b"), p).alias(p) for p in params]).filter(F.col(required) != "")


def graph_node_names(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"\.add_node\s*\(\s*[\"'](\w+)[\"']"), F.lit(1)))
