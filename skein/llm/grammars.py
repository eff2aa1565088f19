"""Token streams and grammars of the languages whose files are checked.

Each lexer yields (class, offset); class BAD stands for what is no token at all,
such as a literal or comment that never ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from skein.llm.derivative import Grammar

Token = tuple[str, int]

# --------------------------------------------------------------------- JSON
_JSON = re.compile(
    r'(?P<ws>[ \t\r\n]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z_.+-]))|(?P<word>[A-Za-z_]+)|(?P<punct>[{}\[\],:])"
)
_ONLY_COMMENTS = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|#[^\n]*)*", re.S)

JSON_GRAMMAR = """
text = [value]
value = object | array | STRING | NUMBER | 'true' | 'false' | 'null'
object = '{' [pair {',' pair}] '}'
pair = STRING ':' value
array = '[' [value {',' value}] ']'
"""


def json_tokens(text: str) -> Iterator[Token]:
    text = text.removeprefix("﻿")
    if _ONLY_COMMENTS.fullmatch(text):
        return
    at = 0
    while at < len(text):
        m = _JSON.match(text, at)
        if m is None:
            yield "BAD", at
            return
        kind = m.lastgroup
        if kind != "ws":
            yield (kind.upper() if kind in ("string", "number") else m.group()), at
        at = m.end()


# --------------------------------------------------------------------- XML
_NAME = r"[A-Za-z_:\x80-\U0010ffff][\w:.\-\xb7\x80-\U0010ffff]*"
_ENTITY = r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"
_VALUE = rf"(?:\"(?:[^<&\"]|{_ENTITY})*\"|'(?:[^<&']|{_ENTITY})*')"
_XML = re.compile(
    rf"(?P<comment><!--(?:(?!--).)*-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)|(?P<decl><\?xml(?:\s+{_NAME}\s*=\s*{_VALUE})*\s*\?>)|(?P<pi><\?(?!xml\s){_NAME}(?:\s.*?)?\?>)"
    rf"|(?P<doctype><!DOCTYPE\s+[^\[<>]*(?:\[[^\]]*\]\s*)?>)"
    rf"|<(?P<open>{_NAME})(?P<attrs>(?:\s+{_NAME}\s*=\s*{_VALUE})*)\s*(?P<empty>/?)>|</(?P<close>{_NAME})\s*>"
    rf"|(?P<space>[ \t\r\n]+(?=<|\Z))|(?P<text>(?:(?!\]\]>)[^<&\x00-\x08\x0b\x0c\x0e-\x1f]|{_ENTITY})+)",
    re.S,
)
_ATTR = re.compile(rf"\s+({_NAME})\s*=\s*{_VALUE}", re.S)

XML_GRAMMAR = """
document = [DECL] {misc} [[DOCTYPE {misc}] element {misc}]
misc = COMMENT | PI | SPACE
element = EMPTY | OPEN {content} CLOSE
content = element | COMMENT | PI | SPACE | TEXT | CDATA
"""


def xml_tokens(text: str) -> Iterator[Token]:
    """Tags as tokens; an end tag whose name is not that of the open one is WRONG_CLOSE."""
    open_names: list[str] = []
    at = 1 if text.startswith("﻿") else 0
    first = at
    while at < len(text):
        m = _XML.match(text, at)
        if m is None:
            yield "BAD", at
            return
        kind = m.lastgroup
        if m.group("open"):
            names = _ATTR.findall(m.group("attrs"))
            if len(names) != len(set(names)):
                yield "BAD", at
                return
            if m.group("empty"):
                yield "EMPTY", at
            else:
                open_names.append(m.group("open"))
                yield "OPEN", at
        elif m.group("close"):
            yield ("CLOSE" if open_names and open_names.pop() == m.group("close") else "WRONG_CLOSE"), at
        elif kind == "decl" and at != first:
            yield "BAD", at
            return
        else:
            yield kind.upper(), at
        at = m.end()


# --------------------------------------------------------------------- T-SQL
# The reserved words of T-SQL (they are no names unless quoted).
TSQL_RESERVED = """
ADD ALL ALTER AND ANY AS ASC AUTHORIZATION BACKUP BEGIN BETWEEN BREAK BROWSE BULK BY CASCADE CASE CHECK CHECKPOINT
CLOSE CLUSTERED COALESCE COLLATE COLUMN COMMIT COMPUTE CONSTRAINT CONTAINS CONTAINSTABLE CONTINUE CONVERT CREATE CROSS
CURRENT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER CURSOR DATABASE DBCC DEALLOCATE DECLARE DEFAULT DELETE
DENY DESC DISK DISTINCT DISTRIBUTED DOUBLE DROP DUMP ELSE END ERRLVL ESCAPE EXCEPT EXEC EXECUTE EXISTS EXIT EXTERNAL
FETCH FILE FILLFACTOR FOR FOREIGN FREETEXT FREETEXTTABLE FROM FULL FUNCTION GOTO GRANT GROUP HAVING HOLDLOCK IDENTITY
IDENTITY_INSERT IDENTITYCOL IF IN INDEX INNER INSERT INTERSECT INTO IS JOIN KEY KILL LEFT LIKE LINENO LOAD MERGE
NATIONAL NOCHECK NONCLUSTERED NOT NULL NULLIF OF OFF OFFSETS ON OPEN OPENDATASOURCE OPENQUERY OPENROWSET OPENXML OPTION
OR ORDER OUTER OVER PERCENT PIVOT PLAN PRECISION PRIMARY PRINT PROC PROCEDURE PUBLIC RAISERROR READ READTEXT
RECONFIGURE REFERENCES REPLICATION RESTORE RESTRICT RETURN REVERT REVOKE RIGHT ROLLBACK ROWCOUNT ROWGUIDCOL RULE SAVE
SCHEMA SECURITYAUDIT SELECT SESSION_USER SET SETUSER SHUTDOWN SOME STATISTICS SYSTEM_USER TABLE TABLESAMPLE TEXTSIZE
THEN TO TOP TRAN TRANSACTION TRIGGER TRUNCATE TRY_CONVERT TSEQUAL UNION UNIQUE UNPIVOT UPDATE UPDATETEXT USE USER
VALUES VARYING VIEW WAITFOR WHEN WHERE WHILE WITH WITHIN WRITETEXT
""".split()  # noqa: SIM905
# Words that mean something in some places and are names elsewhere.
TSQL_SOFT = """
TRY CATCH THROW MATCHED TARGET SOURCE OUTPUT OUT RETURNS AFTER INSTEAD ROWS RANGE PARTITION APPLY USING NEXT OFFSET ONLY
FIRST LAST PRECEDING FOLLOWING UNBOUNDED ROW CAST TRY_CAST INCLUDE READONLY LOGIN TYPE SYNONYM SEQUENCE SCHEMABINDING
ENCRYPTION RECOMPILE CALLER OWNER SELF GO NOCOUNT MAX WORK TIES XML PATH AUTO VALUE ENABLE DISABLE PERSISTED DELAY TIME
LOCAL FAST_FORWARD STATIC FORWARD_ONLY READ_ONLY GLOBAL KEYSET DYNAMIC PRIOR CALLED NO ACTION NOWAIT LOG SETERROR START
HASH LOOP REMOTE ROLLUP CUBE GROUPING SETS AT ZONE SYSTEM_TIME CONTAINED IIF PARSE TRY_PARSE XMLNAMESPACES COLUMNSTORE
REBUILD SWITCH TRANSFER SIGNATURE COUNTER CERTIFICATE FN REPEATABLE SYSTEM SPLIT MASKED HIDDEN PERIOD GENERATED ALWAYS SPARSE
COOKIE SCHEME
""".split()  # noqa: SIM905

_TSQL = re.compile(
    r"(?P<ws>[\s\x00-\x1f\x85\xa0﻿​]+)|(?P<line>--[^\n]*)|(?P<block>/\*)|(?P<string>[Nn]?'(?:[^']|'')*')|(?P<bracket>\[(?:[^\]]|\]\])*\])|(?P<quoted>\"(?:[^\"]|\"\")*\")"
    r"|(?P<number>0[xX][0-9a-fA-F]*(?![\w])|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w@#$])|\$\d+(?:\.\d+)?)|(?P<var>@@?[\w@#$]+)|(?P<name>(?:[^\W\d]|[_#])(?:[\w@#$]|[^\x00-\x9f\s\u200b\ufeff])*)"
    r"|(?P<op><=|>=|<>|!=|!<|!>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%&|^~<>=(),;.:{}])"
)
_BLOCK = re.compile(r"/\*|\*/")
_GO = re.compile(r"[ \t]*GO(?:[ \t]+\d+)?[ \t]*;?[ \t]*(?:--[^\n]*)?\r?(?=\n|\Z)", re.I)


@lru_cache(maxsize=1)
def _tsql_words() -> dict[str, str]:
    return {w: w for w in (*TSQL_RESERVED, *TSQL_SOFT)} | {"PROC": "PROCEDURE", "EXECUTE": "EXEC", "TRAN": "TRANSACTION"}


def tsql_tokens(text: str) -> Iterator[Token]:
    """Tokens of T-SQL; block comments nest, GO alone on its line is BATCH.

    A name starts with a letter and goes on over any characters beyond ASCII
    but blanks: letters that a wrong decoding turned into symbols end no name.
    """
    words = _tsql_words()
    match = _TSQL.match
    at, end = 0, len(text)
    line_start = True
    while at < end:
        if line_start and (g := _GO.match(text, at)):
            yield "BATCH", at
            at, line_start = g.end(), False
            continue
        m = match(text, at)
        if m is None:
            yield "BAD", at
            return
        kind, stop = m.lastgroup, m.end()
        if kind == "ws":
            cut = text.rfind("\n", at, stop)
            if cut >= 0:
                at, line_start = cut + 1, True
                if g := _GO.match(text, at):
                    continue
            line_start = False
            at = stop
            continue
        line_start = False
        if kind == "name":
            yield words.get(m.group().upper(), "NAME"), at
        elif kind == "op":
            yield m.group(), at
        elif kind == "string":
            yield "STRING", at
        elif kind == "number":
            yield "NUMBER", at
        elif kind == "var":
            yield "VAR", at
        elif kind in ("bracket", "quoted"):
            yield ("NAME" if stop - at > 2 else "BAD"), at
        elif kind == "block":
            depth, here = 1, stop
            while depth:
                n = _BLOCK.search(text, here)
                if n is None:
                    yield "BAD", at
                    return
                depth += 1 if n.group() == "/*" else -1
                here = n.end()
            stop = here
        at = stop


_SOFT = " | ".join(w for w in TSQL_SOFT if w not in ("GO",))

TSQL_GRAMMAR = rf"""
script = {{BATCH}} {{';'}} [batch] {{BATCH {{';'}} [batch]}}
batch = module | statements
module = (CREATE [OR ALTER] | ALTER) (procedure | view | function | trigger)
statements = statement {{';' | statement}}
block = BEGIN {{';'}} statements END

name = NAME | {_SOFT}
dotted = name {{'.' {{'.'}} name}}
type = dotted ['(' (NUMBER | MAX) [',' NUMBER] ')'] | NATIONAL dotted | DOUBLE PRECISION | CURSOR
literal = STRING | NUMBER | NULL | DEFAULT
signed = ['-' | '+'] NUMBER

procedure = PROCEDURE dotted [parameters | '(' parameters ')'] [WITH option {{',' option}}] [FOR REPLICATION] AS body
option = name | EXEC AS (CALLER | OWNER | SELF | STRING)
parameters = parameter {{',' parameter}}
parameter = VAR [AS] type [VARYING] [NOT NULL | NULL] ['=' (signed | STRING | NULL | name)] [OUTPUT | OUT] [READONLY]
body = {{';'}} statements
view = VIEW dotted ['(' names ')'] [WITH option {{',' option}}] AS query_full [WITH CHECK OPTION] {{';'}}
names = name {{',' name}}
function = FUNCTION dotted '(' [parameters] ')' RETURNS (type [WITH option {{',' option}}] [AS] block | TABLE [WITH option {{',' option}}] [AS] RETURN (query_full | '(' query_full ')') | VAR TABLE '(' columns ')' [WITH option {{',' option}}] [AS] block) {{';'}}
trigger = TRIGGER dotted ON (dotted | DATABASE | ALL name) [WITH option {{',' option}}] (AFTER | FOR | INSTEAD OF) event {{',' event}} [WITH name] AS body
event = INSERT | UPDATE | DELETE | name

statement = query_full | with_dml | insert | update | delete | merge | declare | set | exec | if | while | block | try | transaction | print | use | truncate | create | alter | drop | grant | return | raise | cursor | BREAK | CONTINUE | GOTO name | waitfor | name ':' | dbcc | toggle | bulk | backup | statistics | context | signature
bulk = BULK INSERT dotted FROM STRING [WITH '(' table_option {{[','] table_option}} ')']
backup = (BACKUP | RESTORE) (DATABASE | LOG | name) (name | VAR) {{',' (name | VAR)}} [(TO | FROM) (name | DISK) '=' (STRING | VAR) {{',' (name | DISK) '=' (STRING | VAR)}}] [WITH backup_option {{',' backup_option}}] | RESTORE name FROM (name | DISK) '=' (STRING | VAR) [WITH backup_option {{',' backup_option}}]
backup_option = name [STRING [TO STRING] | '=' (STRING | NUMBER | VAR | name)] | NOCHECK | CHECKPOINT | FILE '=' NUMBER
statistics = UPDATE STATISTICS dotted [name | '(' names ')'] [WITH statistic {{',' statistic}}]
statistic = name ['=' (NUMBER | ON | OFF)] | name NUMBER (PERCENT | ROWS) | FULL | ALL | INDEX
context = EXEC AS (CALLER | OWNER | SELF | (name | USER) '=' (STRING | VAR)) [WITH (NO REVERT | COOKIE INTO VAR)] | REVERT [WITH COOKIE '=' VAR] | SETUSER [STRING]
signature = (ADD | DROP) [COUNTER] SIGNATURE (TO | FROM) [name '::'] dotted BY signer {{',' signer}}
signer = (CERTIFICATE | name KEY) name [WITH (name '=' STRING | SIGNATURE '=' NUMBER)]
dbcc = DBCC name ['(' [expr {{',' expr}}] ')'] [WITH name {{',' name}}] | CHECKPOINT | RECONFIGURE [WITH name] | KILL expr
toggle = (ENABLE | DISABLE) TRIGGER (names | ALL) ON (dotted | DATABASE)
try = BEGIN TRY {{';'}} statements END TRY {{';'}} BEGIN CATCH {{';'}} [statements] END CATCH
transaction = BEGIN [DISTRIBUTED] TRANSACTION [name | VAR] [WITH name [STRING]] | COMMIT [TRANSACTION | WORK] [name | VAR] | ROLLBACK [TRANSACTION | WORK] [name | VAR] | SAVE TRANSACTION (name | VAR)
print = PRINT expr
use = USE name
truncate = TRUNCATE TABLE dotted
waitfor = WAITFOR (DELAY | TIME) (STRING | VAR)
return = RETURN [expr]
raise = RAISERROR '(' expr {{',' expr}} ')' [WITH name {{',' name}}] | THROW [expr ',' expr ',' expr]
if = IF cond statement_one [{{';'}} ELSE statement_one]
while = WHILE cond statement_one
statement_one = statement
declare = DECLARE declaration {{',' declaration}} | DECLARE name CURSOR {{name}} FOR query_full [FOR (READ name | UPDATE [OF names])]
declaration = VAR [AS] (type ['=' expr] | TABLE '(' columns ')')
cursor = OPEN (name | VAR) | CLOSE (name | VAR) | DEALLOCATE (name | VAR) | FETCH [[NEXT | PRIOR | FIRST | LAST] FROM] (name | VAR) [INTO VAR {{',' VAR}}]
set = SET VAR assign expr | SET VAR '=' CURSOR {{name}} FOR query_full | SET set_option {{',' set_option}} (ON | OFF) | SET name {{name}} (name | NUMBER | STRING | VAR | READ name | ['-'] NUMBER) | SET (IDENTITY_INSERT dotted | STATISTICS (name | TIME)) (ON | OFF) | SET TRANSACTION name name (READ name | name {{name}}) | SET (ROWCOUNT | TEXTSIZE) (NUMBER | VAR)
set_option = name
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^='
exec = EXEC [VAR '='] (dotted | VAR) [argument {{',' argument}}] [WITH name] | EXEC '(' expr {{',' expr}} ')' [AS (name | USER) '=' STRING] [name name]
argument = [VAR '='] (value [OUTPUT | OUT])
value = signed | STRING | NULL | DEFAULT | VAR | dotted

with_dml = WITH (cte {{',' cte}} | XMLNAMESPACES '(' namespace {{',' namespace}} ')' {{',' cte}}) (query | insert | update | delete | merge)
namespace = STRING AS name | DEFAULT STRING
cte = name ['(' names ')'] AS '(' query_full ')'
query_full = query
query = query_term {{(UNION [ALL] | EXCEPT | INTERSECT) query_term}} query_end
query_end = [ORDER BY order {{',' order}} [OFFSET expr (ROW | ROWS) [FETCH (FIRST | NEXT) expr (ROW | ROWS) ONLY]]] [FOR (XML | name) {{name | ',' | '(' STRING ')'}}] [OPTION '(' hint {{',' hint}} ')']
hint = (name | FOR | MERGE | HOLDLOCK | GROUP | ORDER | JOIN | UNION) {{name | NUMBER | JOIN | GROUP | ORDER | UNION | FOR | '(' NUMBER ')'}}
query_term = select | '(' query ')'
select = SELECT [ALL | DISTINCT] [TOP (NUMBER | VAR | '(' expr ')') [PERCENT] [WITH TIES]] item {{',' item}} [INTO dotted] [FROM sources] [WHERE cond] [GROUP BY [ALL] grouping {{',' grouping}} [WITH (ROLLUP | CUBE)]] [HAVING cond]
grouping = expr | '(' ')' | (ROLLUP | CUBE) '(' grouping {{',' grouping}} ')' | GROUPING SETS '(' grouping_set {{',' grouping_set}} ')' | row
grouping_set = grouping
item = '*' | expr [[AS] (name | STRING)] | dotted '.' '*' | VAR assign expr | (name | STRING) '=' expr
order = expr [COLLATE name] [ASC | DESC]
sources = source {{',' source}}
source = table {{join}}
join = ([INNER | (LEFT | RIGHT | FULL) [OUTER]] [MERGE | HASH | LOOP | REMOTE] JOIN source ON cond) | CROSS JOIN table | (CROSS | OUTER) APPLY table
table = (dotted [FOR SYSTEM_TIME period] [TABLESAMPLE [SYSTEM] '(' expr [PERCENT | ROWS] ')' [REPEATABLE '(' expr ')']] | dotted ['(' [expr {{',' expr}}] ')'] | VAR ['.' name '(' expr ')'] | OPENQUERY '(' name ',' STRING ')' | OPENROWSET '(' expr {{',' expr}} ')') [alias] [WITH '(' table_hint {{',' table_hint}} ')' | WITH '(' json_column {{',' json_column}} ')'] [pivot] | '(' query ')' alias ['(' names ')'] [pivot] | '(' VALUES row {{',' row}} ')' alias ['(' names ')'] | '(' source ')'
period = AS OF value | FROM value TO value | BETWEEN value AND value | CONTAINED IN '(' value ',' value ')' | ALL
json_column = name type [STRING] [AS name]
alias = [AS] name
table_hint = name ['(' (name | NUMBER) {{',' (name | NUMBER)}} ')'] | HOLDLOCK | INDEX '(' (name | NUMBER) ')'
pivot = PIVOT '(' expr FOR dotted IN '(' names ')' ')' alias | UNPIVOT '(' name FOR name IN '(' names ')' ')' alias
row = '(' expr {{',' expr}} ')'

insert = INSERT [TOP '(' expr ')'] [INTO] (dotted | VAR) [WITH '(' table_hint {{',' table_hint}} ')'] ['(' names ')'] [output] (VALUES row {{',' row}} | query_full | exec | DEFAULT VALUES)
output = OUTPUT item {{',' item}} [INTO (dotted | VAR) ['(' names ')']]
update = UPDATE [TOP '(' expr ')' [PERCENT]] (dotted | VAR) [WITH '(' table_hint {{',' table_hint}} ')'] SET setting {{',' setting}} [output] [FROM sources] [WHERE cond | WHERE CURRENT OF name] [OPTION '(' hint {{',' hint}} ')']
setting = dotted assign expr | VAR assign [dotted '='] expr | dotted '.' WRITE '(' expr {{',' expr}} ')'
delete = DELETE [TOP '(' expr ')' [PERCENT]] [FROM] (dotted | VAR) [WITH '(' table_hint {{',' table_hint}} ')'] [output] [FROM sources] [WHERE cond | WHERE CURRENT OF name] [OPTION '(' hint {{',' hint}} ')']
merge = MERGE [TOP '(' expr ')'] [INTO] (dotted | VAR) [WITH '(' table_hint {{',' table_hint}} ')'] [alias] USING table ON cond when {{when}} [output] [OPTION '(' hint {{',' hint}} ')']
when = WHEN [NOT] MATCHED [BY (TARGET | SOURCE)] [AND cond] THEN (UPDATE SET setting {{',' setting}} | DELETE | INSERT ['(' names ')'] (VALUES row | DEFAULT VALUES))

create = CREATE (TABLE dotted ['(' columns ')'] [ON name ['(' name ')']] [WITH '(' table_option {{',' table_option}} ')'] | [UNIQUE] [CLUSTERED | NONCLUSTERED] [COLUMNSTORE] INDEX name ON dotted ['(' index_column {{',' index_column}} ')'] [INCLUDE '(' names ')'] [WHERE cond] [WITH '(' table_option {{',' table_option}} ')'] [ON (name | PRIMARY) ['(' name ')']] | SCHEMA name [AUTHORIZATION name] | TYPE dotted (FROM type [NOT NULL | NULL] | AS TABLE '(' columns ')') | SYNONYM dotted FOR dotted | SEQUENCE dotted {{AS type | name [BY] [signed] | START WITH signed | NO name}} | (USER | LOGIN | name) name {{(FOR | FROM | WITH) (LOGIN name | name ['=' (name | STRING)])}} | STATISTICS name ON dotted '(' names ')' | DATABASE name | PARTITION FUNCTION name '(' type ')' AS RANGE [LEFT | RIGHT] FOR VALUES '(' [expr {{',' expr}}] ')' | PARTITION SCHEME name AS PARTITION name [ALL] TO '(' file_group {{',' file_group}} ')' | CERTIFICATE name {{name | WITH | '=' | STRING | ','}})
file_group = name | PRIMARY
table_option = (name | FILLFACTOR) ['=' (name | NUMBER | STRING | ON | OFF)] | ORDER '(' index_column {{',' index_column}} ')'
index_column = name [ASC | DESC]
columns = column {{',' column}} [',']
column = name (type | AS expr [PERSISTED]) {{column_rule}} | [CONSTRAINT name] table_rule | PERIOD FOR SYSTEM_TIME '(' name ',' name ')' | INDEX name {{UNIQUE | CLUSTERED | NONCLUSTERED}} '(' index_column {{',' index_column}} ')'
column_rule = [CONSTRAINT name] (NOT NULL | NULL | PRIMARY KEY [CLUSTERED | NONCLUSTERED] | UNIQUE [CLUSTERED | NONCLUSTERED] | DEFAULT expr | CHECK '(' cond ')' | [FOREIGN KEY] reference) | IDENTITY ['(' signed ',' signed ')'] [NOT FOR REPLICATION] | ROWGUIDCOL | SPARSE | GENERATED ALWAYS AS (ROW | name) (START | END | name) [HIDDEN] | MASKED WITH '(' name '=' STRING ')' | COLLATE name
table_rule = (PRIMARY KEY | UNIQUE) [CLUSTERED | NONCLUSTERED] '(' index_column {{',' index_column}} ')' [WITH '(' table_option {{',' table_option}} ')'] [ON name] | FOREIGN KEY '(' names ')' reference | CHECK '(' cond ')' | DEFAULT expr FOR name
reference = REFERENCES dotted ['(' names ')'] {{ON (DELETE | UPDATE) (CASCADE | SET (NULL | DEFAULT) | NO ACTION)}}
alter = ALTER TABLE dotted [WITH (CHECK | NOCHECK)] (ADD column {{',' column}} | DROP (CONSTRAINT | COLUMN) [IF EXISTS] names | ALTER COLUMN name type [COLLATE name] [NOT NULL | NULL] | (CHECK | NOCHECK) CONSTRAINT (names | ALL) | (ENABLE | DISABLE) TRIGGER (names | ALL) | SWITCH [PARTITION expr] TO dotted [PARTITION expr] | REBUILD [PARTITION '=' (ALL | expr)] [WITH '(' table_option {{',' table_option}} ')'] | SET '(' table_option {{',' table_option}} ')') | ALTER INDEX (name | ALL) ON dotted (name | SET '(' table_option {{',' table_option}} ')') [PARTITION '=' (ALL | expr)] [WITH '(' table_option {{',' table_option}} ')'] | ALTER (ROLE | name) name (ADD | DROP) name name | ALTER DATABASE (name | CURRENT) SET name {{name}} (ON | OFF | name) | ALTER SCHEMA name TRANSFER [(name | TYPE) '::'] dotted | ALTER PARTITION FUNCTION name '(' ')' (SPLIT | MERGE) RANGE '(' expr ')' | ALTER PARTITION SCHEME name NEXT name [name] | ALTER AUTHORIZATION ON [(name | SCHEMA | TYPE | DATABASE) '::'] dotted TO (name | SCHEMA OWNER)
drop = DROP (TABLE | VIEW | PROCEDURE | FUNCTION | TRIGGER | SCHEMA | TYPE | SYNONYM | SEQUENCE | DATABASE | USER | name) [IF EXISTS] dotted {{',' dotted}} | DROP INDEX [IF EXISTS] dotted [ON dotted] | DROP STATISTICS dotted
grant = (GRANT | DENY | REVOKE [GRANT OPTION FOR]) right {{',' right}} [ON [(name | SCHEMA | TYPE) '::'] dotted ['(' names ')']] (TO | FROM) (name | PUBLIC) {{',' (name | PUBLIC)}} [WITH GRANT OPTION] [CASCADE]
right = (SELECT | INSERT | UPDATE | DELETE | EXEC | REFERENCES | ALTER | ALL | CREATE (TABLE | VIEW | PROCEDURE | FUNCTION) | VIEW name | name) ['(' names ')']

cond = cond_one {{(AND | OR) cond_one}}
cond_one = {{NOT}} cond_base
cond_base = special | sign group {{postfix}} more [test] | sign plain {{postfix}} more test
special = EXISTS '(' query ')' | UPDATE '(' name ')' | (CONTAINS | FREETEXT) '(' (dotted | '*' | '(' names ')') ',' expr ')'
test = compare (expr | (ALL | ANY | SOME) '(' query ')') | IS [NOT] (NULL | DISTINCT FROM expr) | [NOT] (IN '(' (query | expr {{',' expr}}) ')' | LIKE expr [ESCAPE expr] | BETWEEN expr AND expr)
compare = '=' | '<>' | '<' | '>' | '<=' | '>=' | '!=' | '!<' | '!>'
expr = unit more
more = {{('+' | '-' | '*' | '/' | '%' | '&' | '|' | '^') unit}}
unit = sign (group | plain) {{postfix}}
sign = {{'+' | '-' | '~'}}
postfix = COLLATE name | '.' name '(' [expr {{',' expr}}] ')' | AT name ZONE unit
group = '(' inside ')'
inside = select set_tail | with_less [set_tail_more]
with_less = inside_one {{(AND | OR) inside_one}}
inside_one = {{NOT}} (special | expr [test])
set_tail = {{(UNION [ALL] | EXCEPT | INTERSECT) query_term}} query_end
set_tail_more = (UNION [ALL] | EXCEPT | INTERSECT) query_term set_tail
plain = STRING | NUMBER | NULL | DEFAULT | VAR | case | call | NEXT VALUE FOR dotted | CURRENT_TIMESTAMP | CURRENT_USER | SESSION_USER | SYSTEM_USER | USER | '{{' FN call '}}' | '{{' name STRING '}}'
call = dotted ['(' [DISTINCT | ALL] [('*' | expr) {{',' expr}}] [FROM expr] ')' [WITHIN GROUP '(' ORDER BY order {{',' order}} ')'] [OVER ('(' over ')' | name)]] | (CAST | TRY_CAST) '(' expr AS type ')' | (CONVERT | TRY_CONVERT) '(' type ',' expr [',' expr] ')' | (COALESCE | NULLIF | LEFT | RIGHT | IDENTITY) '(' [type ','] expr {{',' expr}} ')' | IIF '(' cond ',' expr ',' expr ')' | (PARSE | TRY_PARSE) '(' expr AS type [USING expr] ')' | '$' name
over = [PARTITION BY expr {{',' expr}}] [ORDER BY order {{',' order}}] [(ROWS | RANGE) (bound | BETWEEN bound AND bound)]
bound = UNBOUNDED (PRECEDING | FOLLOWING) | CURRENT ROW | NUMBER (PRECEDING | FOLLOWING)
case = CASE (expr WHEN expr THEN expr {{WHEN expr THEN expr}} | WHEN cond THEN expr {{WHEN cond THEN expr}}) [ELSE expr] END
"""

# --------------------------------------------------------------------- Python
# The reserved words of Python.
PY_KEYWORDS = """
False None True and as assert async await break class continue def del elif else except finally for from global if
import in is lambda nonlocal not or pass raise return try while with yield
""".split()  # noqa: SIM905

# Words of Python that are names except at the start of some statements.
PY_SOFT = ("match", "case", "type")

_PY = re.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<comment>#[^\n]*)|(?P<nl>\r?\n)"
    r"|(?P<string>(?:[rRbBuU]|[fF]|[rR][bBfF]|[bBfF][rR])?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\n]|\\.)*'|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"))"
    r"|(?P<number>(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?)(?!\w))|(?P<name>[^\W\d](?:\w|[^\x00-\x9f\s])*)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])",
    re.S,
)


_PY_FORMATTED = re.compile(r"(?:[fF][rR]?|[rR][fF])('{3}|\"{3}|'|\")")
_PY_LITERAL = re.compile(r"[rRbBuU]{0,2}(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\n]|\\.)*'|\"(?!\"\")(?:[^\"\\\n]|\\.)*\")", re.S)
_PY_WORD = re.compile(r"\w+|#[^\n]*")


def _formatted_end(text: str, at: int, quote: str) -> int:
    """Where the formatted literal ends whose text begins at ``at``, or -1; its fields may hold literals with the same quotes."""
    modes = ["text"]  # text, field or format; a field also counts its open brackets
    depth: list[int] = []
    while at < len(text):
        c = text[at]
        if modes[-1] != "field":
            if text.startswith(quote, at):
                return at + len(quote) if len(modes) == 1 else -1
            if c == "\n" and len(quote) == 1:
                return -1
            if text.startswith("\\N{", at):
                at = text.find("}", at) + 1 or len(text)
            elif c == "\\" and text[at + 1 : at + 2] not in ("{", "}"):
                at += 2
            elif modes[-1] == "text" and text[at : at + 2] in ("{{", "}}"):
                at += 2
            elif c == "}":
                if modes.pop() == "text":
                    return -1
                modes.pop()
                depth.pop()
                at += 1
            else:
                if c == "{":
                    modes.append("field")
                    depth.append(0)
                at += 1
        elif m := _PY_FORMATTED.match(text, at):
            at = _formatted_end(text, m.end(), m.group(1))
            if at < 0:
                return -1
        elif m := _PY_LITERAL.match(text, at) or _PY_WORD.match(text, at):
            at = m.end()
        elif c in "'\"":
            return -1
        else:
            if c == "}" and not depth[-1]:
                modes.pop()
                depth.pop()
            elif c == ":" and not depth[-1]:
                modes.append("format")
            else:
                depth[-1] += (c in "([{") - (c in ")]}")
            at += 1
    return -1


def python_tokens(text: str) -> Iterator[Token]:
    """Tokens of Python with NEWLINE, INDENT and DEDENT."""
    keywords = {*PY_KEYWORDS, *PY_SOFT}
    text = text.removeprefix("﻿")
    indents, depth, at, fresh = [0], 0, 0, True
    ended = True
    while at < len(text):
        if fresh and depth == 0:
            m = re.compile(r"[ \t\f]*").match(text, at)
            width = len(m.group().expandtabs(8))
            here = m.end()
            if here < len(text) and text[here] not in "#\r\n":
                if width > indents[-1]:
                    indents.append(width)
                    yield "INDENT", here
                while width < indents[-1]:
                    indents.pop()
                    yield "DEDENT", here
                if width != indents[-1]:
                    yield "BAD", here
                    return
            at, fresh = here, False
            continue
        if text[at] in "fFrR" and (f := _PY_FORMATTED.match(text, at)):
            end = _formatted_end(text, f.end(), f.group(1))
            yield ("STRING" if end >= 0 else "BAD"), at
            if end < 0:
                return
            at, ended = end, False
            continue
        m = _PY.match(text, at)
        if m is None:
            yield "BAD", at
            return
        kind, word = m.lastgroup, m.group()
        if kind == "nl":
            if depth == 0:
                fresh = True
                if not ended:
                    yield "NEWLINE", at
                    ended = True
        elif kind not in ("ws", "comment"):
            ended = False
            if kind == "name":
                yield (word if word in keywords else "NAME"), at
            elif kind in ("string", "number"):
                yield kind.upper(), at
            else:
                depth += (word in "([{") - (word in ")]}")
                depth = max(depth, 0)
                yield word, at
        at = m.end()
    if depth:  # the text stops inside brackets
        return
    if not ended:
        yield "NEWLINE", at
    for _ in indents[1:]:
        yield "DEDENT", at


PY_GRAMMAR = """
file = {statement}
statement = simple | compound
simple = small {';' small} [';'] NEWLINE
small = expressions [{'=' right} | augment right | ':' test ['=' right]] | 'del' expressions | 'pass' | 'break' | 'continue' | 'return' [expressions] | 'raise' [test ['from' test]] | 'global' name {',' name} | 'nonlocal' name {',' name} | 'assert' test [',' test] | import | 'type' name [type_parameters] '=' test
augment = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
right = expressions
import = 'import' dotted ['as' name] {',' dotted ['as' name]} | 'from' ({'.' | '...'} dotted | {'.' | '...'} ('.' | '...')) 'import' ('*' | as_names | '(' as_names [','] ')')
as_names = name ['as' name] {',' name ['as' name]}
dotted = name {'.' name}
compound = match | if | while | for | try | with | def | class | decorated | 'async' (def | with | for)
if = 'if' named ':' suite {'elif' named ':' suite} ['else' ':' suite]
while = 'while' named ':' suite ['else' ':' suite]
for = 'for' targets 'in' expressions ':' suite ['else' ':' suite]
try = 'try' ':' suite (except {except} ['else' ':' suite] ['finally' ':' suite] | 'finally' ':' suite)
except = 'except' ['*'] [test {',' test} ['as' name]] ':' suite
with = 'with' (with_item {',' with_item} | '(' with_item {',' with_item} [','] ')') ':' suite
with_item = test ['as' target]
def = 'def' name [type_parameters] '(' [parameters] ')' ['->' test] ':' suite
parameters = parameter {',' parameter} [',']
parameter = name [':' test] ['=' test] | '*' [name [':' star]] | '**' name [':' test] | '/'
class = 'class' name [type_parameters] ['(' [arguments] ')'] ':' suite
decorated = '@' named NEWLINE ({'@' named NEWLINE}) ('async' def | def | class)
suite = simple | NEWLINE INDENT statement {statement} DEDENT
expressions = star {',' star} [',']
star = named | '*' bitor
named = test [':=' test]
targets = target {',' target} [',']
target = ['*'] bitor_no_in
bitor_no_in = bitor
test = or ['if' or 'else' test] | lambda | 'yield' ['from' test | expressions]
lambda = 'lambda' [lambda_parameter {',' lambda_parameter} [',']] ':' test
lambda_parameter = name ['=' test] | '*' [name] | '**' name | '/'
or = and {'or' and}
and = not {'and' not}
not = {'not'} comparison
comparison = bitor {compare bitor}
compare = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' ['not']
bitor = arith {('|' | '^' | '&' | '<<' | '>>') arith}
arith = factor {('+' | '-' | '*' | '/' | '//' | '%' | '@' | '**') factor}
factor = {'+' | '-' | '~'} ['await'] power
power = atom {trailer}
trailer = '(' [arguments] ')' | '[' subscripts ']' | '.' name
subscripts = subscript {',' subscript} [',']
subscript = named | '*' bitor | [test] ':' [test] [':' [test]]
arguments = argument {',' argument} [',']
argument = named [comp] | name '=' test | '*' test | '**' test
comp = ['async'] 'for' targets 'in' or {['async'] 'for' targets 'in' or | 'if' (named | lambda)}
atom = name | NUMBER | STRING {STRING} | 'None' | 'True' | 'False' | '...' | '(' [star (comp | {',' star} [','])] ')' | '[' [star (comp | {',' star} [','])] ']' | '{' [dict_or_set] '}'
dict_or_set = entry ({',' entry} [','] | comp) | star ({',' star} [','] | comp)
entry = test ':' test | '**' bitor
match = 'match' expressions ':' NEWLINE INDENT case {case} DEDENT
case = 'case' patterns ['if' named] ':' suite
patterns = pattern_star {',' pattern_star} [',']
pattern_star = '*' name | pattern
pattern = pattern_one {'|' pattern_one} ['as' name]
pattern_one = ['-'] NUMBER [('+' | '-') NUMBER] | STRING {STRING} | 'None' | 'True' | 'False' | name {'.' name} ['(' [argument_pattern {',' argument_pattern} [',']] ')'] | '(' [patterns] ')' | '[' [patterns] ']' | '{' [entry_pattern {',' entry_pattern} [',']] '}'
argument_pattern = [name '='] pattern
entry_pattern = pattern_one ':' pattern | '**' name
type_parameters = '[' type_parameter {',' type_parameter} [','] ']'
type_parameter = ['*' | '**'] name [':' test] ['=' star]
name = NAME | 'match' | 'case' | 'type'
"""

LEXERS = {"tsql": tsql_tokens, "json": json_tokens, "xml": xml_tokens, "python": python_tokens}
_TEXTS = {"tsql": TSQL_GRAMMAR, "json": JSON_GRAMMAR, "xml": XML_GRAMMAR, "python": PY_GRAMMAR}


@lru_cache(maxsize=8)
def grammar(lang: str) -> Grammar:
    return Grammar(_TEXTS[lang])


def examine(text: str | None, lang: str) -> tuple[str, int | None]:
    """("sound" | "fails" | "ends early", code-point offset of the failing token or None)."""
    if not text or not text.strip():
        return "sound", None
    tokens = list(LEXERS[lang](text))
    verdict, at = grammar(lang).run(name for name, _ in tokens)
    if verdict == "fails" and tokens[at][0] == "BAD" and _unclosed(text, tokens[at][1], lang):
        verdict = "ends early"
    return verdict, (tokens[at][1] if verdict != "sound" and at < len(tokens) else len(text) if verdict != "sound" else None)


def _unclosed(text: str, at: int, lang: str) -> bool:
    """Whether what is no token is a literal, comment or tag that the end of the text cuts off."""
    if lang == "xml":
        return text.startswith("<", at) and ">" not in text[at:]
    return text.startswith({"json": '"', "python": ("'", '"', "f'", 'f"', "F'", 'F"')}.get(lang, ("/*", "'", '"', "[", "N'", "n'")), at)
