"""Fixed values shared by the operators."""

# --- fixed values: markers and special tokens of the training text ---------------------------
BACK = "[BACK]"
CONTEXT = "[CONTEXT]"
QUESTION = "[QUESTION]"
REASONING = "[REASONING]"
SQL = "[SQL]"
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
LABEL_MASK = -100
LABEL_WRONG = 1
LABEL_CORRECT = 0
CONFIDENCE_RADIUS = 10
TOP_VALUES = 3

# --- fixed values: vocabulary specials of the word-level tokeniser ---------------------------
PAD, UNK, BOS, EOS = "<pad>", "<unk>", "<bos>", "<eos>"
SPECIAL_TOKENS = [PAD, UNK, BOS, EOS, BACK, CONTEXT, QUESTION, REASONING, SQL, TURN_START, TURN_END]

# --- fixed values: declared column formats ---------------------------------------------------
RANGE_FORMATS = ["integer", "real", "datetime", "date"]
KNOWN_FORMATS = RANGE_FORMATS + ["text"]
UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

# --- fixed values: difficulty names of the question sets -> report levels --------------------
DIFFICULTY_LEVELS = {"simple": "EASY", "moderate": "MEDIUM", "challenging": "HARD"}

# --- fixed values: query prefix of the retrieval encoder -------------------------------------
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

# --- fixed values: the characters str.strip() removes ----------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: English stop words (public NLTK list). Entries with an apostrophe are left
# out: link text keeps only a-z, 0-9 and blanks, so they can never match. ---------------------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma
mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# --- fixed values: words the Treebank rules cut in two ---------------------------------------
SPLIT_WORDS = {"cannot": 3, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "wanna": 3}

# --- fixed values: prompt texts --------------------------------------------------------------
KNOWLEDGE_LINE = "-- External Knowledge: {knowledge}"
PROMPT_TEXTS = {
    "sql": {
        "schema": "{database_schema}",
        "question": "-- {question}",
        "with_knowledge": "-- Using valid SQLite and understanding External Knowledge, "
        "answer the following questions for the tables provided above.",
        "no_knowledge": "-- Using valid SQLite, answer the following questions for the tables provided above.",
        "cot": "Generate the SQL after thinking step by step: ",
    },
    "schema_linking": {
        "schema": "Database Schema: \n{database_schema}",
        "question": "-- Question: {question}",
        "with_knowledge": "-- Based on Database Schema provided above and understanding External Knowledge, "
        "your task is to select table-column pairs (called `schema links`) most relevant to the given Question.",
        "no_knowledge": "-- Based on Database Schema provided above, "
        "your task is to select table-column pairs most relevant to the given Question.",
        "cot": "Choose the relevant table-column pairs after thinking step by step: ",
    },
}
SELECT_OPENER = "\nSELECT "

# --- fixed value: the request that asks a model for the steps of a query ----------------------
STEP_REQUEST = """You are a SQL expert. When I provide you with a SQL query, your task is to describe step-by-step how a person would create such a query. Follow the standard SQL execution order. Write the steps from the perspective of someone constructing the query. If the query includes subqueries, describe them step-by-step in the same detailed manner as the main query before referencing them. Each step should represent a distinct operation. Make the operations as granular as possible.

Here is the standard SQL execution order you should follow for your explanation. If a given clause is not present in the query, skip it without mentioning its absence:
1. FROM clause (including JOINs).
2. WHERE clause.
3. GROUP BY clause.
4. HAVING clause.
5. SELECT clause.
6. ORDER BY clause.
7. LIMIT clause.

For each query I provide:
1. Explain the query step by step in plain language.
2. Ensure that each step corresponds to one small, logical operation.
3. Use clear and concise language for each operation.
4. Each step should be provided in a single line (use single newline character between steps).

Here is an example query for your reference:
```
SELECT T1.name, T1.email, SUM(T3.amount) AS total_sales FROM Customers AS T1 INNER JOIN Orders AS T2 ON T1.customer_id = T2.customer_id LEFT JOIN OrderDetails AS T3 ON T2.order_id = T3.order_id WHERE T2.order_date >= '2023-01-01' AND T2.order_date <= (SELECT order_date FROM Orders WHERE order_id = '1' ORDER BY order_date DESC LIMIT 1) GROUP BY T1.name, T1.email ORDER BY total_sales DESC
```
The expected step-by-step breakdown for the above query:
Define the main table in the FROM clause: `FROM Customers AS T1`.
Define the first JOIN operation: `INNER JOIN`.
Define the table to join: `Orders AS T2`.
Define the join condition: `ON T1.customer_id = T2.customer_id`.
Define the second JOIN operation: `LEFT JOIN`.
Define the table to join: `OrderDetails AS T3`.
Define the join condition: `ON T2.order_id = T3.order_id`.
Define the main filtering condition in the WHERE clause: `WHERE T2.order_date >= '2023-01-01'`.
Add the additional filtering condition in the WHERE clause : `AND T2.order_date <= (subquery)`.
Define the main table in the subquery's FROM clause: `FROM Orders`.
Define the main filtering condition in the subquery's WHERE clause: `WHERE order_id = '1'`.
Select the column to be included in the subquery result: `SELECT order_date`.
Order the subquery results by the specified column: `ORDER BY order_date DESC`.
Limit the subquery results: `LIMIT 1`.
Complete the filtering condition in the WHERE clause: `AND T2.order_date <= (SELECT order_date FROM Orders WHERE order_id = '1' ORDER BY order_date DESC LIMIT 1)`.
Group the results by the specified columns: `GROUP BY T1.name, T1.email`.
Select the columns to be included in the final result: `SELECT T1.name, T1.email, SUM(T3.amount) AS total_sales`.
Order the results by the specified column: `ORDER BY total_sales DESC`.

Now, I will provide you with a query, and I expect you to respond in this format:
```
{sql_query}
```
"""
