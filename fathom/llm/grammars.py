"""Grammars of TypeScript, TypeScript with JSX, JavaScript, C# and JSON for one level of brackets.

A bracketed group is a single token whose terminals are the roles its own content can play (BLOCK,
OBJ, PARAMS, ...). The rules named in ROLES say how a role's content looks. Operators of all ranks are
one flat list, as ranks don't decide whether a text is valid. N is a line break that may end a
statement.
"""

from __future__ import annotations

_SCRIPT = r"""
List = Skip (Stmt Skip)* Last? ;
Skip = (N | ';')* ;
End = ';' | N ;
Stmt = Compound | Simple End ;
Last = Simple | 'if' PAREN N? Last | 'if' PAREN N? Stmt Skip 'else' N? Last | 'for' 'await'? FORHEAD N? Last | 'while' PAREN N? Last ;
Compound = BLOCK | 'if' PAREN N? Body (N? 'else' N? Body)? | 'for' 'await'? FORHEAD N? Body | 'while' PAREN N? Body
  | 'do' N? Body N? 'while' PAREN | 'try' BLOCK N? ('catch' CATCH? BLOCK N?)? ('finally' BLOCK)? | 'switch' PAREN SWITCH
  | 'with' PAREN N? Body | ID ':' N? Body | Function | Class | Deco* 'export' ('default')? (Function | Class) @COMPOUND ;
Body = Stmt | ';' ;
Simple = Expr | Var | 'return' Expr? | 'throw' Expr | ('break' | 'continue') ID? | 'debugger' | Import | Export @SIMPLE ;
Var = ('const' | 'let' | 'var' | 'await'? 'using') Bind (',' Bind)* ;
Bind = (ID | OBJPAT | ARRPAT) @BANG @ANN ('=' Assign)? ;
Import = 'import' @TYPEWORD (STR | Clause 'from' STR) (('with' | 'assert') OBJ)? ;
Clause = ID (',' (NAMED | '*' 'as' ID))? | NAMED | '*' 'as' ID ;
Export = 'export' Var | 'export' 'default' Assign | 'export' @TYPEWORD '*' ('as' (NAME | STR))? 'from' STR | 'export' @TYPEWORD NAMED ('from' STR)? @EXPORT ;
Function = 'async'? 'function' '*'? ID? @TPARAMS PARAMS @RET (BLOCK @BODILESS) ;
Class = Deco* @ABSTRACT 'class' ID? @TPARAMS ('extends' Operand)? @IMPLEMENTS CLASSBODY ;
Deco = '@' Primary Suffix* N? ;
Expr = Assign (',' Assign)* ;
Assign = Operand (Bin Operand @AS)* (Q Assign ':' Assign | '=' Assign | ASSIGN Assign | '>'+ GE Assign)? | Arrow | 'yield' '*'? Assign? ;
Q = '?' ;
Bin = OP | '+' | '-' | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '|' | '&' | 'in' | 'instanceof' ;
Operand = Prefix* Primary Suffix* ;
Prefix = '+' | '-' | '!' | '~' | INC | 'typeof' | 'void' | 'delete' | 'await' | 'new' @CAST ;
Suffix = '.' NAME | '.' PRIVATE | '?.' (NAME | PRIVATE | ARGS | INDEX | TEMPLATE) | ARGS | INDEX | TEMPLATE | INC @SUFFIX ;
Primary = ID | NUM | STR | TEMPLATE | REGEX | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false' | ARRAY | OBJ | PAREN | 'import' ARGS | 'import' '.' NAME | 'new' '.' NAME
  | 'async'? 'function' '*'? ID? @TPARAMS PARAMS @RET BLOCK | Class @JSX ;
Arrow = 'async'? (ID | @TPARAMS PARAMS @RET) '=>' (BLOCK | Assign) ;
Key = NAME | STR | NUM | INDEX | PRIVATE ;

Args = ((Spread | Assign) (',' (Spread | Assign))* ','?)? ;
Spread = '...' Assign ;
Params = (Param (',' Param)* ','?)? ;
Param = Deco* @PARAMMOD ('...')? (ID | 'this' | OBJPAT | ARRPAT) @OPT @ANN ('=' Assign)? ;
For = (Var | Expr)? ';' Expr? ';' Expr? | ('const' | 'let' | 'var' | 'using') (ID | OBJPAT | ARRPAT) ('of' | 'in') Expr | Operand ('of' | 'in') Expr ;
Catch = (ID | OBJPAT | ARRPAT) @ANN ;
Array = ','* ((Spread | Assign) (','+ (Spread | Assign))* ','*)? ;
ArrPat = ','* (Elem (','+ Elem)* ','*)? ;
Elem = '...'? (ID | OBJPAT | ARRPAT | Operand) ('=' Assign)? ;
Obj = (Prop (',' Prop)* ','?)? ;
Prop = Spread | Key ':' Assign | ID ('=' Assign)? | ('async' | 'get' | 'set')? '*'? Key @TPARAMS PARAMS @RET BLOCK ;
ObjPat = (PatProp (',' PatProp)* ','?)? ;
PatProp = '...' ID | ID ('=' Assign)? | Key ':' Elem ;
Switch = N* (('case' Expr | 'default') ':' List)* ;
Named = (Spec (',' Spec)* ','?)? ;
Spec = @TYPEWORD (NAME | STR) ('as' (NAME | STR))? ;
ClassBody = (N | ';' | Member | Field End)* Field? ;
Member = Deco* Mod* '*'? Key @OPT @TPARAMS PARAMS @RET (BLOCK @BODILESS) | Deco* Mod* ('get' | 'set') Key PARAMS @RET (BLOCK @BODILESS) | 'static' BLOCK @INDEXSIG ;
Field = Deco* Mod* Key @OPT @BANG @ANN ('=' Assign)? ;
Mod = ('static' | 'async' | 'accessor' @MODS) N? ;
JsxExpr = ('...'? Expr)? ;
"""

_TYPES = r"""
Ann = ':' Type ;
Ret = ':' (Type | Guard) ;
Guard = 'asserts' (ID | 'this') ('is' Type)? | (ID | 'this') 'is' Type ;
TArgs = '<' Type (',' Type)* ','? '>' ;
TParams = '<' TParam (',' TParam)* ','? '>' ;
TParam = ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)? ;
Type = ('|' | '&')? TOp (('|' | '&') TOp)* ('extends' Type '?' Type ':' Type)? | 'abstract'? 'new'? TParams? PARAMS '=>' (Type | Guard) ;
TOp = ('keyof' | 'unique' | 'readonly' | 'infer')* TPost ;
TPost = TPrim TYINDEX* ;
TPrim = ID ('.' NAME)* TArgs? | STR | '-'? NUM | TEMPLATE | 'true' | 'false' | 'null' | 'void' | 'this' | 'typeof' (ID | 'this' | 'import' ARGS) ('.' NAME)* TArgs? | TYPEBODY | TUPLE | TYPEPAREN | 'import' ARGS ('.' NAME)* TArgs? ;
TypeBody = (TMember (',' | ';' | N)+)* TMember? ;
TMember = ('readonly' | '+' 'readonly' | '-' 'readonly')? (Key | INDEXKEY) ('+' | '-')? '?'? Ann? | ('get' | 'set')? Key? '?'? TParams? PARAMS Ret? | 'new' TParams? PARAMS Ret? ;
TyIndex = Type? ;
Tuple = (TElem (',' TElem)* ','?)? ;
TElem = '...'? (ID '?'? ':')? Type '?'? ;
IndexKey = ID ':' Type | ID 'in' Type ('as' Type)? ;
Interface = 'interface' ID TParams? ('extends' Type (',' Type)*)? TYPEBODY ;
Alias = 'type' ID TParams? '=' Type ;
Enum = 'const'? 'enum' ID ENUMBODY ;
EnumBody = (EMember (',' EMember)* ','?)? ;
EMember = (NAME | STR | INDEX) ('=' Assign)? ;
Namespace = ('namespace' | 'module') (ID ('.' ID)* | STR) BLOCK | 'global' BLOCK ;
Ambient = 'declare' (Var | Alias | 'abstract'? Function | ('namespace' | 'module') STR) ;
"""

_JSX = r"""
Jsx = JOPEN JName? TArgsJ JAttr* (JSELF | JEND Child* JCLOSE JName? JEND) ;
TArgsJ = ;
JName = NAME (('.' | ':' | '-') NAME)* ;
JAttr = JName ('=' (STR | JEXPR | Jsx))? | JEXPR ;
Child = JTEXT | JEXPR | Jsx ;
"""

_PLAIN = dict.fromkeys("COMPOUND SIMPLE BANG ANN TYPEWORD EXPORT TPARAMS RET BODILESS ABSTRACT IMPLEMENTS AS CAST SUFFIX JSX PARAMMOD OPT INDEXSIG MODS".split(), "")
_TYPED = _PLAIN | {
    "COMPOUND": "| Deco* 'export'? 'default'? 'declare'? (Interface | Enum | Namespace | Class | Function)", "SIMPLE": "| Alias | Ambient | 'import' ID '=' Operand | 'export' '=' Expr",
    "BANG": "'!'?", "ANN": "Ann?", "TYPEWORD": "'type'?", "EXPORT": "| 'export' (Alias | Ambient) | 'export' 'as' 'namespace' ID", "TPARAMS": "TParams?", "RET": "Ret?", "BODILESS": "| End",
    "ABSTRACT": "'abstract'?", "IMPLEMENTS": "('implements' Type (',' Type)*)?", "AS": "(('as' | 'satisfies') ('const' | Type))*", "CAST": "| '<' Type '>'", "SUFFIX": "| '!' | TArgs",
    "PARAMMOD": "('public' | 'private' | 'protected' | 'readonly' | 'override')*", "OPT": "'?'?", "INDEXSIG": "| Mod* INDEXKEY Ann? End",
    "MODS": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
}


def _fill(text: str, marks: dict[str, str]) -> str:
    for k in sorted(marks, key=len, reverse=True):
        text = text.replace(f"@{k}", marks[k])
    return text


JAVASCRIPT = _fill(_SCRIPT, _PLAIN)
#: Strict code with imports and exports, and sloppy code without them.
MODULE = JAVASCRIPT.replace("| 'with' PAREN N? Body ", "")
CLASSIC = JAVASCRIPT.replace(" | Import | Export", "").replace(" | Deco* 'export' ('default')? (Function | Class)", "")
TYPESCRIPT = _fill(_SCRIPT, _TYPED).replace("Assign = Operand (Bin", "Assign = Operand (('as' | 'satisfies') ('const' | Type))* (Bin") + _TYPES
TSX = _fill(_SCRIPT, _TYPED | {"JSX": "| Jsx", "CAST": ""}).replace("Assign = Operand (Bin", "Assign = Operand (('as' | 'satisfies') ('const' | Type))* (Bin") + _TYPES + _JSX

CSHARP = r"""
Unit = Using* Attr* (FileSpace Using*)? Top* ;
Top = Space | TypeDecl | Stmt ;
Using = 'global'? 'using' ('static' | 'unsafe')? (ID '=')? Type ';' | 'extern' 'alias' ID ';' ;
FileSpace = 'namespace' QName ';' ;
Space = 'namespace' QName SPACEBODY ';'? ;
QName = ID TArgs? (('.' | '::') ID TArgs?)* ;
SpaceBody = Using* (Space | TypeDecl)* ;
Attr = ATTRS ;
Attrs = (ID ':' | 'return' ':' | 'event' ':')? AttrOne (',' AttrOne)* ','? ;
AttrOne = QName ARGS? ;
Mod = 'public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'sealed' | 'abstract' | 'virtual' | 'override' | 'partial' | 'async' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'required' | 'file' | 'ref' | 'const' | 'fixed' ;
TypeDecl = Attr* Mod* ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) ID TParams? PARAMS? (':' Base (',' Base)*)? Where* (TYPEBODY ';'? | ';')
  | Attr* Mod* 'enum' ID (':' Type)? ENUMBODY ';'? | Attr* Mod* 'delegate' Type ID TParams? PARAMS Where* ';' ;
Base = Type ARGS? ;
Where = 'where' ID ':' Limit (',' Limit)* ;
Limit = Type | 'class' '?'? | 'struct' | 'new' ARGS | 'default' | 'notnull' | 'unmanaged' | 'allows' 'ref' 'struct' ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Attr* ('in' | 'out')? ID ;
TArgs = '<' Type? (',' Type?)* '>' ;
Type = ('ref' 'readonly'? | 'scoped')? TypeHead TypeTail* ;
TypeHead = PREDEF | 'var' | 'dynamic' | ID TArgs? (('.' | '::') ID TArgs?)* | TUPLETYPE | 'delegate' '*' TArgs ;
TypeTail = '?' | RANK | '*' ;
Body = BLOCK | '=>' Expr ';' | ';' ;
TypeBody = Member* ;
Member = TypeDecl
  | Attr* Mod* 'event'? Type Decl (',' Decl)* ';' | Attr* Mod* 'event' Type QName ACCESSORS
  | Attr* Mod* Type QName TParams? PARAMS Where* Body
  | Attr* Mod* ID PARAMS (':' ('base' | 'this') ARGS)? Body | Attr* Mod* '~' ID PARAMS Body
  | Attr* Mod* Type QName (ACCESSORS ('=' Init ';')? | '=>' Expr ';')
  | Attr* Mod* Type (QName '.')? 'this' PARAMSQ (ACCESSORS | '=>' Expr ';')
  | Attr* Mod* Type 'operator' 'checked'? (OP | '+' | '-' | '*' | '<' | '>' | '>' '>' | '!' | '~' | INC | 'true' | 'false') PARAMS Body
  | Attr* Mod* ('implicit' | 'explicit') 'operator' 'checked'? Type PARAMS Body ;
Decl = ID RANKED? ('=' Init)? ;
Init = Expr | INIT | 'ref' Expr ;
EnumBody = (EMember (',' EMember)* ','?)? ;
EMember = Attr* ID ('=' Expr)? ;
Accessors = (Attr* Mod* ('get' | 'set' | 'init' | 'add' | 'remove') Body)+ ;
Params = (Param (',' Param)*)? ;
Param = Attr* ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* Type ID ('=' Expr)? ;

List = Stmt* ;
Stmt = BLOCK | ';' | LocalDecl ';' | Expr ';' | LocalFn | ID ':' Stmt
  | 'if' PAREN Stmt ('else' Stmt)? | 'while' PAREN Stmt | 'do' Stmt 'while' PAREN ';' | 'for' FORHEAD Stmt | 'await'? 'foreach' EACH Stmt | 'switch' PAREN SWITCH | 'switch' TUPLE SWITCH
  | 'return' ('ref'? Expr)? ';' | 'throw' Expr? ';' | 'break' ';' | 'continue' ';' | 'goto' (ID | 'default' | 'case' Expr) ';' | ID 'return' Expr ';' | ID 'break' ';'
  | 'try' BLOCK Catch* ('finally' BLOCK)? | 'await'? 'using' (USINGHEAD | PAREN) Stmt | 'await'? 'using' LocalDecl ';' | 'lock' PAREN Stmt | 'fixed' USINGHEAD Stmt
  | ('checked' | 'unchecked' | 'unsafe') BLOCK ;
LocalDecl = ('const' | 'static' | 'scoped')* Type Decl (',' Decl)* | 'var' DECON '=' Expr ;
LocalFn = Attr* ('static' | 'async' | 'unsafe' | 'extern')* Type ID TParams? PARAMS Where* Body ;
Catch = 'catch' CATCHHEAD? ('when' PAREN)? BLOCK ;
Switch = ((('case' Pattern ('when' Expr)? | 'default') ':')+ Stmt+)* ;
ForHead = (LocalDecl | Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? ;
Each = ('ref' 'readonly'?)? (Type ID | 'var' DECON | TUPLE) 'in' Expr ;
CatchHead = Type ID? ;
UsingHead = LocalDecl ;
Decon = ID (',' ID)+ | DECON ;

Expr = Operand (Bin Operand | 'is' Pattern | 'as' Type | 'switch' ARMS | 'with' INIT)* ('?' Expr ':' Expr | ('=' | ASSIGN | '>'+ GE) ('ref'? Expr | INIT))? | Lambda | 'throw' Expr | Query | 'ref' Expr ;
Bin = OP | '+' | '-' | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '..' ;
Operand = Prefix* Primary Suffix* | Prefix* '..' Operand? | Primary Suffix* '..' ;
Prefix = '+' | '-' | '!' | '~' | '^' | '*' | '&' | INC | 'await' | CAST ;
Primary = ID TArgs? | ID '::' ID | PREDEF | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'base' | PAREN | TUPLE | LISTEXPR | 'default' TYPEPAREN? | ('typeof' | 'sizeof') TYPEPAREN | ('checked' | 'unchecked') PAREN
  | 'new' Type ARGS? INIT? | 'new' TypeHead TypeTail* RANKED RANK* INIT? | 'new' ARGS INIT? | 'new' RANK INIT | 'new' ANON | 'stackalloc' (Type? (RANKED | RANK))? INIT? | 'delegate' PARAMS? BLOCK ;
Suffix = '.' ID TArgs? | '?.' ID TArgs? | '?' INDEX | '->' ID | ARGS | INDEX | '!' | INC | 'switch' ARMS ;
Lambda = Attr* ('async' | 'static')* (ID | Type? PARAMS | LPARAMS) '=>' (BLOCK | Expr | 'ref' Expr) | ('async' | 'static')* 'delegate' PARAMS? BLOCK ;
LParams = (('ref' | 'out' | 'in')? ID (',' ID)*)? ;
Query = 'from' Type? ID 'in' Expr Clause* ('select' Expr | 'group' Expr 'by' Expr) ('into' ID Clause* ('select' Expr | 'group' Expr 'by' Expr))? ;
Clause = 'from' Type? ID 'in' Expr | 'where' Expr | 'let' ID '=' Expr | 'orderby' Expr ('ascending' | 'descending')? (',' Expr ('ascending' | 'descending')?)* | 'join' Type? ID 'in' Expr 'on' Expr 'equals' Expr ('into' ID)? ;
Args = (Arg (',' Arg)*)? ;
Arg = (ID ':')? ('ref' | 'out' | 'in')? (Expr | Type ID | 'var' ID) ;
Tuple = Arg (',' Arg)+ ;
TupleType = Type ID? (',' Type ID?)+ ;
ListExpr = (('..'? Expr) (',' '..'? Expr)* ','?)? ;
InitList = (InitOne (',' InitOne)* ','?)? ;
InitOne = (ID | INDEX) '=' (Expr | INIT) | Expr | INIT ;
Anon = (AnonOne (',' AnonOne)* ','?)? ;
AnonOne = (ID '=')? Expr ;
Rank = ','* ;
Ranked = Expr (',' Expr)* ;
Index = Arg (',' Arg)* ;
Arms = (Arm (',' Arm)* ','?)? ;
Arm = Pattern ('when' Expr)? '=>' Expr ;
Pattern = PUnary (('and' | 'or') PUnary)* ;
PUnary = 'not'* PAtom ;
PAtom = Expr | ('<' | '>' | OP) Expr | Type? (POSPAT)? PROPPAT? ID? | 'var' (ID | DECON) | LISTPAT ID? | '..' Pattern? | PATPAREN | Type ID ;
PosPat = ((ID ':')? Pattern (',' (ID ':')? Pattern)*)? ;
PropPat = ((ID ('.' ID)* ':' Pattern) (',' ID ('.' ID)* ':' Pattern)* ','?)? ;
ListPat = (Pattern (',' Pattern)*)? ;
"""

JSON = r"""
Value = OBJ | ARRAY | STR | NUM | 'true' | 'false' | 'null' ;
Obj = (STR ':' Value (',' STR ':' Value)*)? ;
Array = (Value (',' Value)*)? ;
"""

_SCRIPT_ROLES = {
    "(": {"ARGS": "Args", "PAREN": "Expr", "PARAMS": "Params", "FORHEAD": "For", "CATCH": "Catch"},
    "[": {"ARRAY": "Array", "INDEX": "Expr", "ARRPAT": "ArrPat"},
    "{": {"BLOCK": "List", "OBJ": "Obj", "OBJPAT": "ObjPat", "CLASSBODY": "ClassBody", "SWITCH": "Switch", "NAMED": "Named", "JEXPR": "JsxExpr"},
}
_TYPE_ROLES = {"(": {"TYPEPAREN": "Type"}, "[": {"TYINDEX": "TyIndex", "TUPLE": "Tuple", "INDEXKEY": "IndexKey"}, "{": {"TYPEBODY": "TypeBody", "ENUMBODY": "EnumBody"}}
_JSON_ROLES: dict = {"(": {}, "[": {"ARRAY": "Array"}, "{": {"OBJ": "Obj"}}

#: grammar -> (text, start symbols, roles of each bracket)
ROLES = {
    "module": (MODULE, ["List"], _SCRIPT_ROLES),
    "classic": (CLASSIC, ["List"], _SCRIPT_ROLES),
    "typescript": (TYPESCRIPT, ["List"], {b: _SCRIPT_ROLES[b] | _TYPE_ROLES[b] for b in "([{"}),
    "tsx": (TSX, ["List"], {b: _SCRIPT_ROLES[b] | _TYPE_ROLES[b] for b in "([{"}),
    "csharp": (CSHARP, ["Unit"], {
        "(": {"ARGS": "Args", "PAREN": "Expr", "PARAMS": "Params", "FORHEAD": "ForHead", "EACH": "Each", "CATCHHEAD": "CatchHead", "USINGHEAD": "UsingHead", "DECON": "Decon", "TYPEPAREN": "Type", "CAST": "Type", "TUPLE": "Tuple", "TUPLETYPE": "TupleType", "LPARAMS": "LParams", "POSPAT": "PosPat", "PATPAREN": "Pattern"},
        "[": {"ATTRS": "Attrs", "RANK": "Rank", "RANKED": "Ranked", "INDEX": "Index", "LISTEXPR": "ListExpr", "LISTPAT": "ListPat", "PARAMSQ": "Params"},
        "{": {"BLOCK": "List", "TYPEBODY": "TypeBody", "ENUMBODY": "EnumBody", "ACCESSORS": "Accessors", "INIT": "InitList", "ANON": "Anon", "SWITCH": "Switch", "ARMS": "Arms", "PROPPAT": "PropPat", "SPACEBODY": "SpaceBody"},
    }),
    "json": (JSON, ["Value"], _JSON_ROLES),
}
