"""Grammars and lexers for the languages that are checked for validity (see parsing.py)."""

from __future__ import annotations

import re

from quarryline.llm.derivatives import END, Grammar

# ---------------------------------------------------------------- Python

PY_HARD = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield".split())
PY_SOFT = {"match", "case", "type", "_"}

PYTHON = """
file = NEWLINE? line* ;
line = simple | compound ;
simple = small (';' small)* ';'? NEWLINE ;
small = exprs | 'pass' | 'break' | 'continue' | 'del' targets | 'return' stars? | 'raise' (test ('from' test)?)? | 'global' NAME (',' NAME)*
  | 'nonlocal' NAME (',' NAME)* | 'assert' test (',' test)? | import | 'type' NAME tparams? '=' test ;
exprs = stars (':' test ('=' rhs)? | AUG rhs | ('=' rhs)*) ;
rhs = yield | stars ;
yield = 'yield' ('from' test | stars)? ;
stars = staritem (',' staritem)* ','? | yield ;
staritem = '*' bitor | named ;
targets = bitor (',' bitor)* ','? ;
import = 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* | 'from' ('.'* dotted | '.' '.'*) 'import' ('*' | '(' names ','? ')' | names) ;
names = NAME ('as' NAME)? (',' NAME ('as' NAME)?)* ;
dotted = NAME ('.' NAME)* ;
compound = if | while | for | try | with | def | class | decorated | match | 'async' (def | for | with) ;
suite = simple | NEWLINE INDENT line+ DEDENT ;
if = 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? ;
while = 'while' named ':' suite ('else' ':' suite)? ;
for = 'for' fortargets 'in' stars ':' suite ('else' ':' suite)? ;
fortargets = fortarget (',' fortarget)* ','? ;
fortarget = '*'? bitor ;
try = 'try' ':' suite (('except' (test ('as' NAME | (',' test)*)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)?
  | ('except' '*' test ('as' NAME | (',' test)*)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite) ;
with = 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' suite ;
withitem = test ('as' fortarget)? ;
def = 'def' NAME tparams? '(' params? ')' ('->' test)? ':' suite ;
params = param (',' param)* ','? ;
param = NAME (':' staritem)? ('=' test)? | '*' (NAME (':' staritem)?)? | '**' NAME (':' test)? | '/' ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ('*' | '**')? NAME (':' test)? ('=' staritem)? ;
class = 'class' NAME tparams? ('(' args? ')')? ':' suite ;
decorated = ('@' named NEWLINE)+ (def | class | 'async' def) ;
match = 'match' stars ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' suite)+ DEDENT ;
patterns = pattern (',' pattern)* ','? ;
pattern = '*' NAME | orpat ('as' NAME)? ;
orpat = closed ('|' closed)* ;
closed = NAME ('.' NAME)* ('(' patargs? ')')? | literal | '(' patterns? ')' | '[' patterns? ']' | '{' mappats? '}' ;
literal = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' ;
patargs = patarg (',' patarg)* ','? ;
patarg = pattern | NAME '=' pattern ;
mappats = mappat (',' mappat)* ','? ;
mappat = (literal | NAME ('.' NAME)+) ':' pattern | '**' NAME ;
named = test | NAME ':=' test ;
test = or ('if' or 'else' test)? | lambda ;
lambda = 'lambda' lparams? ':' test ;
lparams = lparam (',' lparam)* ','? ;
lparam = NAME ('=' test)? | '*' NAME? | '**' NAME | '/' ;
or = not (('and' | 'or') not)* ;
not = 'not'* compare ;
compare = bitor (COMP bitor | 'in' bitor | 'not' 'in' bitor | 'is' 'not'? bitor)* ;
bitor = unary (BIN unary | '*' unary | '-' unary | '+' unary | '/' unary | '**' unary | '@' unary | '|' unary)* ;
unary = ('-' | '+' | '~')* 'await'? power ;
power = atom trailer* ;
atom = NAME | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (stars compfor? )? ')' | '[' (stars compfor?)? ']' | '{' (dictset)? '}' ;
dictset = named dicttail | '*' bitor setrest | '**' bitor dictrest ;
dicttail = ':' test (compfor | dictrest) | compfor | setrest ;
setrest = (',' staritem)* ','? ;
dictrest = (',' pair)* ','? ;
pair = test ':' test | '**' bitor ;
trailer = '(' args? ')' | '[' subs ']' | '.' NAME ;
args = arg (',' arg)* ','? ;
arg = named compfor? | NAME '=' test | '*' test | '**' test ;
subs = sub (',' sub)* ','? ;
sub = '*' bitor | named slice? | slice ;
slice = ':' test? (':' test?)? ;
compfor = ('async'? 'for' fortargets 'in' or ('if' (or | lambda | NAME ':=' test))*)+ ;
"""
PY = Grammar(PYTHON, "file", {
    "NAME": {"NAME"} | PY_SOFT, "NUM": {"NUM"}, "STR": {"STR"}, "NEWLINE": {"NEWLINE"}, "INDENT": {"INDENT"}, "DEDENT": {"DEDENT"},
    "AUG": {"AUG"}, "COMP": {"COMP"}, "BIN": {"BIN"}})

_PY_PREFIX = r"(?:[rRbBuU]|[bB][rR]|[rR][bB])?"
_PY_F = r"(?:[fF][rR]?|[rR][fF])"
_PY_FIELD = r"\{[^'\"\\\n{}]*\}"
PY_TOKEN = re.compile(
    r"[ \t\f]*("
    r"(?>[A-Za-z_]\w*)(?!['\"])"
    r"|[()\[\]{},;~]"
    r"|\n[ \t\f]*(?:(?:#[^\n]*\n|\r?\n)[ \t\f]*)*"
    rf"|{_PY_PREFIX}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
    r"|\"(?:[^\"\\\n]|\\\r\n|\\[\s\S])*\"|'(?:[^'\\\n]|\\\r\n|\\[\s\S])*')"
    rf"|{_PY_F}(?:\"(?!\"\")(?:[^\"\\\n{{}}]|\\[^\n]|\{{\{{|\}}\}}|{_PY_FIELD})*\"|'(?!'')(?:[^'\\\n{{}}]|\\[^\n]|\{{\{{|\}}\}}|{_PY_FIELD})*')"
    rf"|{_PY_F}(?=['\"])"
    r"|(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w])"
    r"|\.\.\.|[.@](?!=)|:=|:|==|=|->|-=|-|\*\*=|\*\*|\*=|\*|//=|//|/=|/|>>=|>>|>=|>|<<=|<<|<=|<|!=|[+%&|^@]=|[+%&|^@]"
    r"|\r?\n|#[^\n]*|[^\W\d]\w*|\\\r?\n|\Z|[\s\S])")

_PY_PUNCT = {
    **{x: "AUG" for x in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()},
    **{x: "COMP" for x in "< > <= >= == !=".split()},
    **{x: "BIN" for x in "// % & ^ << >>".split()},
}
_OLD_OCTAL = re.compile(r"0[0-9_]*[1-9][0-9_]*")


class PyKinds(dict):
    """Kind of a token's text; odd texts are errors, blanks and remarks have no kind (-1)."""

    def __missing__(self, tok: str) -> int:
        c = tok[:1]
        if tok in ("", "\r") or c == "#" or c == "\\" and len(tok) > 1:
            out = -1
        elif tok in PY_HARD or tok in PY_SOFT:
            out = PY.kind(tok)
        elif tok in _PY_PUNCT:
            out = PY.kind(_PY_PUNCT[tok])
        elif c.isdecimal() or c == "." and tok[1:2].isdecimal():
            out = PY.kind("ERROR" if _OLD_OCTAL.fullmatch(tok) else "NUM")
        elif tok[-1] in "'\"" and len(tok) > 1:
            out = PY.kind("STR")
        elif tok.isidentifier():
            out = PY.kind("NAME")
        elif tok in PY.kinds:
            out = PY.kind(tok)
        else:
            out = PY.kind("ERROR")
        if len(self) > 300_000:
            self.clear()
        self[tok] = out
        return out


PY_KINDS = PyKinds()

# ---------------------------------------------------------------- JSON

JSON = """
value = object | array | STR | NUM | WORD ;
object = '{' (STR ':' value (',' STR ':' value)*)? '}' ;
array = '[' (value (',' value)*)? ']' ;
"""
JS_ON = Grammar(JSON, "value", {"STR": {"STR"}, "NUM": {"NUM"}, "WORD": {"WORD"}})
JSON_TOKEN = re.compile(
    r"[ \t\n\r]*(\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[\da-fA-F]{4})*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|[{}\[\]:,]|\Z|[^ \t\n\r])")


class JsonKinds(dict):
    def __missing__(self, tok: str) -> int:
        if tok == "":
            out = -1
        elif tok[0] == '"' and len(tok) > 1:
            out = JS_ON.kind("STR")
        elif tok[0] in "-0123456789" and tok != "-":
            out = JS_ON.kind("NUM")
        elif tok in ("true", "false", "null"):
            out = JS_ON.kind("WORD")
        else:
            out = JS_ON.kind(tok if tok in JS_ON.kinds else "ERROR")
        if len(self) > 300_000:
            self.clear()
        self[tok] = out
        return out


JSON_KINDS = JsonKinds()

# ---------------------------------------------------------------- ECMAScript and TypeScript

JS_HARD = set(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with enum".split())
#: Words that are names unless the grammar asks for them.
JS_SOFT = {"async", "await", "yield", "let", "static", "of", "get", "set", "from", "as", "target", "meta", "accessor"}
TS_SOFT = set(
    "abstract any asserts declare global implements infer interface is keyof module namespace never out override private protected public "
    "readonly require satisfies type unique using".split())

SCRIPT = """
program = HASHBANG? item* ;
item = import | export | stmt ;
block = '{' stmt* '}' ;
end = ';' | &end ;
stmt = block | var | fn | class | if | loop | switch | try | jump | NAME ':' stmt | exprstmt | ';' | more ;
exprstmt = !{ '{' 'function' 'class' 'enum' } (expr end) ;
var = 'var' vardecl (',' vardecl)* end | 'let' vardecl (',' vardecl)* end | 'const' constdecl (',' constdecl)* end ;
vardecl = NAME definite ann init? | pattern ann init ;
constdecl = NAME ann init | pattern ann init ;
init = '=' assign ;
fn = 'async'? 'function' '*'? NAME signature fnbody ;
fnbody = block ;
signature = tparams '(' params? ')' returns ;
params = param (',' param)* (',' rest?)? | rest ;
rest = '...' target ann ;
param = decorators modifiers target opt ann init? | thisparam ;
target = NAME | pattern ;
pattern = '{' (patprop (',' patprop)* (',' patrest?)? | patrest)? '}' | '[' ','* (patitem (',' ','* patitem)* (',' ','* patrest | ','*) | patrest)? ']' ;
patrest = '...' target ;
patitem = target init? ;
patprop = NAME init? | propkey ':' target init? ;
propkey = PROP | STR | NUM | '[' assign ']' ;
if = 'if' '(' expr ')' stmt ('else' stmt)? ;
loop = 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'for' 'await'? '(' forhead ')' stmt | 'with' '(' expr ')' stmt ;
forhead = (expr | ('var' | 'let' | 'const') vardecl (',' vardecl)*)? ';' expr? ';' expr?
  | (('var' | 'let' | 'const') target | unary) (('in') expr | 'of' assign) ;
switch = 'switch' '(' expr ')' '{' ('case' expr ':' stmt* | 'default' ':' stmt*)* '}' ;
try = 'try' block ('catch' ('(' target ann ')')? block ('finally' block)? | 'finally' block) ;
jump = 'return' expr? end | 'throw' expr end | ('break' | 'continue') NAME? end | 'debugger' end ;
import = 'import' importtype (STR | importnames 'from' STR) importwith end | importmore ;
importnames = NAME (',' ('*' 'as' NAME | imports))? | '*' 'as' NAME | imports ;
imports = '{' (importitem (',' importitem)* ','?)? '}' ;
importitem = importtype ((PROP | STR) 'as' NAME | NAME) ;
importwith = ('with' object)? ;
export = 'export' ('default' (defaultfn | defaultclass | defaultmore | !{ 'function' 'class' } (assign end)) | exportdecl
  | importtype ('*' ('as' (PROP | STR))? 'from' STR importwith | exports ('from' STR importwith)?) end | exportmore) ;
exports = '{' (exportitem (',' exportitem)* ','?)? '}' ;
exportitem = importtype (PROP | STR) ('as' (PROP | STR))? ;
exportdecl = var | fn | class | declmore ;
defaultfn = 'async'? 'function' '*'? NAME? signature fnbody ;
defaultclass = decorators classmods 'class' NAME? classrest ;
class = decorators classmods 'class' NAME classrest ;
classrest = tparams ('extends' heritage)? implements '{' member* '}' ;
heritage = lhs ;
member = ';' | decorators membermods (('get' | 'set' | 'async' '*'? | '*') memberkey opt signature methodbody | memberkey (opt signature methodbody | field)) | 'static' block | index ;
methodbody = block ;
memberkey = PROP | STR | NUM | '[' assign ']' | PRIVATE ;
field = optdefinite ann init? end ;
expr = assign (',' assign)* ;
assign = arrow | 'yield' ('*'? assign)? | ('new')* (place placed | value valued) | (PREFIX | '-' | '+' | 'typeof' | 'void' | 'delete' | 'await' | INCR | castmore)+ (lhs INCR? | PRIVATE 'in' unary) operators | PRIVATE 'in' unary operators ;
place = NAME | array | object | '(' expr ')' ;
value = 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | template | fnexpr | classexpr | element | 'new' '.' 'target' | 'import' ('(' assign (',' assign)? ','? ')' | '.' 'meta') ;
placed = ASSIGN assign | valued ;
valued = INCR? operators | access placed | args valued | template valued | '?.' (PROP | PRIVATE | '[' expr ']' | args) valued | suffixed ;
access = '.' (PROP | PRIVATE) | '[' expr ']' ;
operators = (BINOP unary | '*' unary | '-' unary | '+' unary | '<' unary | '>' unary | '/' unary | 'in' unary | 'instanceof' unary | asmore)* ('?' assign ':' assign)? ;
arrow = 'async'? NAME '=>' arrowbody | 'async'? arrowparams '=>' arrowbody ;
arrowparams = tparams '(' params? ')' returns ;
arrowbody = block | !{ '{' } assign ;
unary = (PREFIX | '-' | '+' | 'typeof' | 'void' | 'delete' | 'await' | INCR | castmore)* (lhs INCR? | PRIVATE 'in' unary) ;
lhs = ('new')* (primary | 'new' '.' 'target' | 'import' ('(' assign (',' assign)? ','? ')' | '.' 'meta')) suffix* ;
suffix = '.' (PROP | PRIVATE) | '?.' (PROP | PRIVATE | '[' expr ']' | args) | '[' expr ']' | args | template | suffixmore ;
args = '(' (arg (',' arg)* ','?)? ')' ;
arg = '...'? assign ;
primary = NAME | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | template | array | object | fnexpr | classexpr | '(' expr ')' | element ;
template = TPL | THEAD expr (TMID expr)* TTAIL ;
array = '[' ','* (arg (',' ','* arg)* ','*)? ']' ;
object = '{' (property (',' property)* ','?)? '}' ;
property = NAME ('=' assign)? | propkey (':' assign | signature block) | '...' assign | ('get' | 'set' | 'async' '*'? | '*') propkey signature block ;
fnexpr = 'async'? 'function' '*'? NAME? signature block ;
classexpr = decorators 'class' NAME? classrest ;
element = JOPEN (JNAME jtargs jattr*)? (JSELF | JEND jchild* JCLOSE JNAME? JEND) ;
jattr = JNAME (JEQ (JSTR | '{' assign '}' | element))? | '{' '...' assign '}' ;
jchild = JTEXT | '{' ('...'? expr)? '}' | element ;
"""
#: Rules that only TypeScript fills.
PLAIN_HOOKS = """
more = NEVER ;
definite = ;
ann = ;
opt = ;
optdefinite = ;
returns = ;
tparams = ;
decorators = ('@' lhs)* ;
modifiers = ;
classmods = ;
membermods = 'static'? ;
implements = ;
index = NEVER ;
importtype = ;
importmore = NEVER ;
exportmore = NEVER ;
declmore = NEVER ;
defaultmore = NEVER ;
asmore = NEVER ;
castmore = NEVER ;
suffixmore = NEVER ;
suffixed = NEVER ;
jtargs = ;
thisparam = NEVER ;
"""
TYPE_HOOKS = """
more = interface | alias | enum | namespace | 'declare' (var | fn | class | interface | alias | enum | namespace | 'global' block) ;
interface = 'interface' NAME tparams ('extends' typeref (',' typeref)*)? typebody ;
alias = 'type' NAME tparams '=' type end ;
enum = 'const'? 'enum' NAME '{' (enumitem (',' enumitem)* ','?)? '}' ;
enumitem = (PROP | STR) init? ;
namespace = ('namespace' | 'module') (NAME ('.' NAME)* | STR) ('{' item* '}' | end) ;
definite = '!'? ;
ann = (':' type)? ;
opt = '?'? ;
optdefinite = ('?' | '!')? ;
returns = (':' (type | ('asserts')? (NAME | 'this') ('is' type)? ))? ;
tparams = ('<' tparam (',' tparam)* ','? '>')? ;
tparam = ('const' | 'in' | 'out')* NAME ('extends' type)? ('=' type)? ;
decorators = ('@' lhs)* ;
modifiers = ('public' | 'private' | 'protected' | 'readonly' | 'override')* ;
classmods = 'abstract'? ;
membermods = ('public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'accessor')* ;
implements = ('implements' typeref (',' typeref)*)? ;
index = membermods '[' NAME ':' type ']' ann end ;
fnbody = block | end ;
methodbody = block | end ;
constdecl = NAME ann init? | pattern ann init ;
heritage = lhs targs? ;
importtype = 'type'? ;
importmore = 'import' 'type'? NAME '=' ('require' '(' STR ')' | NAME ('.' NAME)*) end ;
exportmore = '=' expr end | 'as' 'namespace' NAME end ;
declmore = more | importmore ;
defaultmore = interface ;
asmore = ('as' | 'satisfies') type ;
castmore = '<' type '>' ;
suffixmore = '!' | targs ;
suffixed = '!' placed | targs valued ;
jtargs = targs? ;
thisparam = 'this' ann ;
targs = '<' type (',' type)* ','? '>' ;
typebody = '{' (typemember ((',' | ';') | &end))* '}' ;
typemember = modifiers (typekey opt ann | ('get' | 'set')? typekey opt signature | signature | 'new' signature | '[' NAME ':' type ']' ann) ;
typekey = PROP | STR | NUM | '[' assign ']' ;
typeref = NAME ('.' PROP)* targs? ;
type = fntype | condtype ;
fntype = 'abstract'? 'new'? tparams '(' params? ')' '=>' (type | ('asserts')? (NAME | 'this') 'is' type) ;
condtype = union ('extends' union '?' type ':' type)? ;
union = ('|' | '&')? typeop (('|' | '&') (typeop | fntype))* ;
typeop = ('keyof' | 'unique' | 'readonly' | 'infer')* posttype ('extends' typeop)? ;
posttype = basetype ('[' type? ']')* ;
basetype = NAME ('.' PROP)* targs? | 'this' | 'void' | 'null' | 'true' | 'false' | STR | '-'? NUM | 'typeof' (NAME | 'this' | 'import' '(' STR ')') ('.' PROP)* targs?
  | 'import' '(' STR ')' ('.' PROP)* targs? | '(' type ')' | '[' (tupleitem (',' tupleitem)* ','?)? ']' | typebody | mapped | TPL | THEAD type (TMID type)* TTAIL ;
tupleitem = '...'? (NAME '?'? ':')? type '?'? ;
mapped = '{' (('+' | '-')? 'readonly')? '[' NAME 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? ';'? '}' ;
"""

_PUNCT_CLASSES = {
    "ASSIGN": "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split(),
    "INCR": ["++", "--"], "PREFIX": ["!", "~"],
    "BINOP": "% ** << >> >>> <= >= == != === !== & ^ | && || ??".split(),
}


def _script(typed: bool) -> Grammar:
    soft = JS_SOFT | (TS_SOFT if typed else set())
    text = SCRIPT + (TYPE_HOOKS if typed else PLAIN_HOOKS)
    classes = {
        "NAME": {"NAME"} | soft, "PROP": {"NAME"} | soft | JS_HARD,
        **{k: set(v) for k, v in _PUNCT_CLASSES.items()},
        **{k: {k} for k in "STR NUM REGEX TPL THEAD TMID TTAIL PRIVATE HASHBANG JOPEN JNAME JSELF JEND JCLOSE JEQ JSTR JTEXT".split()},
    }
    if typed:  # '>' comes one at a time, so that it can close type arguments
        text = text.replace("'>' unary |", "'>' ('>' ('>')?)? unary |").replace("placed = ASSIGN assign", "placed = (ASSIGN | '>' '>' '>'? '=') assign").replace("BINOP unary |", "BINOP unary | '>' '=' unary |")
    g = Grammar(text, "program", classes)
    brace = g.kind("}")
    g.kind("ERROR")
    g.conditions["end"] = lambda t: t == END or t & 1 or t == brace
    return g


JS, TS = _script(False), _script(True)

_REGEX_BODY = r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*"
_SPACE = r"(?:[ \t\f\v\u00a0\ufeff\u2000-\u200a\u3000]|\r(?!\n)|/\*[^*\n]*(?:\*(?!/)[^*\n]*)*\*/)*"
_NAME = r"(?:[^\W\d]|[$\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*"
_NUMBER = r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?))(?![\w$])"
_STRING = r"\"(?:[^\"\\\n\r]|\\\r\n|\\[\s\S])*\"|'(?:[^'\\\n\r]|\\\r\n|\\[\s\S])*'"
_OPERATORS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|/(?![/*])|[{}()\[\];,<>+\-*%&|^!~?:=@]|\.(?!\d)"
_LINE = r"(?:\s|//[^\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*[\n\u2028\u2029](?:\s|//[^\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*"
_SIMPLE_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^`{}'\"/]*\})*`"


def _fast(operators: str) -> re.Pattern:
    """One match per token; an operator takes a regular expression that follows it along."""
    return re.compile(
        rf"[ \t]*(return[ \t]+{_REGEX_BODY}|(?>[A-Za-z_$][\w$]*)(?!\\)|\n\s*|[)}}\]]|[=(,:\[!&|?;][ \t]*{_REGEX_BODY}|{operators}"
        rf"|{_STRING}|{_NUMBER}|{_SIMPLE_TEMPLATE}|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|\s|{_NAME}|#{_NAME}|\Z|[\s\S])")


_TS_OPERATORS = _OPERATORS.replace(r">>>=|", "", 1).replace(r">>=|>>>|", "", 1).replace(r"<=|>=|", "<=|", 1).replace(r"<<|>>|", "<<|", 1)
FAST = {id(JS): _fast(_OPERATORS), id(TS): _fast(_TS_OPERATORS)}
_WITH_REGEX = re.compile(rf"([=(,:\[!&|?;]|return)[ \t]*({_REGEX_BODY})")


class ScriptKinds(dict):
    """Kind of a token's text for the fast lexer. -1: none; 1: a line break; a tuple: several kinds."""

    def __init__(self, grammar: Grammar, check):
        self.g, self.check = grammar, check
        self.words = JS_HARD | JS_SOFT | (TS_SOFT if grammar is TS else set())

    def word(self, tok: str) -> int:
        return self.g.kind(tok if tok in self.words else "NAME")

    def __missing__(self, tok: str):
        g, c = self.g, tok[:1]
        if tok == "":
            out = -1
        elif c.isalpha() or c in "_$" or c > "\x7f" and re.fullmatch(_NAME, tok):
            m = _WITH_REGEX.fullmatch(tok)
            out = (g.kind("return"), g.kind("REGEX")) if m else self.word(tok)
        elif c.isspace() or tok[:2] == "/*":
            out = 1 if re.search("[\n\u2028\u2029]", tok) else -1
        elif tok[:2] == "//":
            out = -1
        elif c in "'\"" and len(tok) > 1:
            out = g.kind("STR")
        elif c == "`" and len(tok) > 1:
            holes = re.findall(r"\$\{([^`{}'\"/]*)\}", re.sub(r"\\[\s\S]", "", tok))
            out = g.kind("TPL" if all(map(self.check, holes)) else "ERROR")
        elif c.isdigit() or c == "." and tok[1:2].isdigit():
            out = g.kind("NUM")
        elif c == "#" and len(tok) > 1:
            out = g.kind("PRIVATE")
        elif m := _WITH_REGEX.fullmatch(tok):
            out = (g.kind(m[1]), g.kind("REGEX"))
        else:
            out = g.kind(tok if tok in g.kinds else "ERROR")
        if len(self) > 300_000:
            self.clear()
        self[tok] = out
        return out


# the careful lexer: knows where an operand may begin, templates within templates, and JSX

_SKIP = re.compile(r"(?:\s|\ufeff|//[^\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_CAREFUL = {k: re.compile(rf"({_NAME})|({_STRING})|({_NUMBER})|(#{_NAME})|({ops})") for k, ops in ((id(JS), _OPERATORS), (id(TS), _TS_OPERATORS))}
_MAY_SKIP = frozenset(" \t\n\r\f\v/\u00a0\ufeff\u2028\u2029\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_RX = re.compile(_REGEX_BODY)
_JCLOSE = re.compile(r"<\s*/")
_JBEGIN = re.compile(r"<\s*(?:[A-Za-z_$>])")
_TPARAMS = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
_TPART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JNAME = re.compile(r"[^\W\d][\w\-]*(?:[:.][\w\-]+)*|\$[\w$]*")
_JSTR = re.compile(r"\"[^\"]*\"|'[^']*'")
_JTEXT = re.compile(r"[^{}<>]+")
#: Words after which an operand begins.
_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await", "default", "extends"}


def careful(text: str, g: Grammar, jsx: bool):
    """(kind, offset, line break before) of each token; kind ERROR where nothing fits."""
    words = JS_HARD | JS_SOFT | (TS_SOFT if g is TS else set())
    token, kinds = _CAREFUL[id(g)].match, g.kinds
    kind, error = kinds.__getitem__, kinds["ERROR"]
    at, size, operand, named = 0, len(text), True, False  # named: the tag has an attribute
    braces: list[str] = []  # what each open brace is: '{', '${' (template) or 'J' (JSX)
    tags: list[str] = []
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size
        yield kind("HASHBANG"), 0, False

    mode = ["code"]
    while True:
        if mode[-1] == "child":
            c = text[at : at + 1]
            if c == "":
                return
            if c == "{":
                yield kind("{"), at, False
                mode.append("code"), braces.append("J")
                at, operand = at + 1, True
            elif c == "<":
                mode.append("tag")
                close = _JCLOSE.match(text, at)
                yield kind("JCLOSE" if close else "JOPEN"), at, False
                at = close.end() if close else at + 1
                tags.append("/" if close else "")
                named = False
            elif c in "}>":
                yield kind("ERROR"), at, False
                at += 1
            else:
                m = _JTEXT.match(text, at)
                yield kind("JTEXT"), at, False
                at = m.end()
            continue
        line = False
        if at < size and text[at] in _MAY_SKIP:
            end = _SKIP.match(text, at).end()
            if end > at + 1 or text[at] != " ":
                blank = text[at:end]
                line = "\n" in blank or "\u2028" in blank or "\u2029" in blank
            at = end
        if at >= size:
            return
        c = text[at]
        if mode[-1] == "tag":
            if c == "/" and text[at + 1 : at + 2] == ">" and not tags[-1].startswith("/"):
                yield kind("JSELF"), at, False
                at += 2
                tags.pop(), mode.pop()
                operand = False
            elif c == ">":
                yield kind("JEND"), at, False
                at += 1
                name = tags.pop()
                mode.pop()
                if name.startswith("/"):  # closes the children of an element
                    if mode[-1] != "child" or not tags or tags.pop() != "=" + name[1:]:
                        yield kind("ERROR"), at, False
                        return
                    mode.pop()
                    operand = False
                else:
                    tags.append("=" + name)
                    mode.append("child")
            elif c == "{":
                yield kind("{"), at, False
                mode.append("code"), braces.append("J")
                at, operand = at + 1, True
            elif c == "=":
                yield kind("JEQ"), at, False
                at += 1
                if m := _JSTR.match(text, _SKIP.match(text, at).end()):
                    yield kind("JSTR"), m.start(), False
                    at = m.end()
            elif c == "<" and g is TS and tags[-1] not in ("", "/") and not named:  # type arguments of a tag
                depth = 0
                while at < size:
                    at = _SKIP.match(text, at).end()
                    m = token(text, at)
                    if not m:
                        yield error, at, False
                        return
                    yield kinds.get(m[0], error) if m.lastindex == 5 else kind("STR" if m.lastindex == 2 else "NUM" if m.lastindex == 3 else m[0] if m[0] in words else "NAME"), at, False
                    at = m.end()
                    depth += {"<": 1, ">": -1}.get(m[0], 0)
                    if not depth:
                        break
            elif m := _JNAME.match(text, at):
                named = tags[-1] not in ("", "/")
                if tags[-1] in ("", "/"):
                    tags[-1] += m[0]
                yield kind("JNAME"), at, False
                at = m.end()
            else:
                yield kind("ERROR"), at, False
                return
            continue
        if c == "`":
            m = _TPART.match(text, at + 1)
            if not m:
                yield kind("ERROR"), at, line
                return
            if m[1] == "`":
                yield kind("TPL"), at, line
                operand = False
            else:
                yield kind("THEAD"), at, line
                braces.append("${")
                operand = True
            at = m.end()
            continue
        if c == "}" and braces:
            what = braces.pop()
            if what == "${":
                m = _TPART.match(text, at + 1)
                if not m:
                    yield kind("ERROR"), at, line
                    return
                yield kind("TTAIL" if m[1] == "`" else "TMID"), at, line
                operand = m[1] != "`"
                if operand:
                    braces.append("${")
                at = m.end()
                continue
            if what == "J":
                yield kind("}"), at, line
                at += 1
                mode.pop()
                continue
            yield kind("}"), at, line
            at, operand = at + 1, True
            continue
        if operand and c == "/" and (m := _RX.match(text, at)):
            yield kind("REGEX"), at, line
            at, operand = m.end(), False
            continue
        if jsx and operand and c == "<" and _JBEGIN.match(text, at) and not (
            g is TS and _TPARAMS.match(text, at)
        ):
            yield kind("JOPEN"), at, line
            mode.append("tag"), tags.append("")
            at, named = at + 1, False
            continue
        m = token(text, at)
        if not m:
            yield kind("ERROR"), at, line
            at += 1
            continue
        tok, which = m[0], m.lastindex
        if which == 1:
            yield kind(tok if tok in words else "NAME"), at, line
            operand = tok in _BEFORE_OPERAND
        elif which in (2, 3):
            yield kind("STR" if which == 2 else "NUM"), at, line
            operand = False
        elif which == 4:
            yield kind("PRIVATE"), at, line
            operand = False
        else:
            if tok == "{":
                braces.append("{")
            yield kinds.get(tok, error), at, line
            operand = tok not in (")", "]", "++", "--")
        at = m.end()
