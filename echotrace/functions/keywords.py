"""Reserved words per language (fixed values: fingerprints depend on them)."""

from __future__ import annotations

# Fixed values.
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while with yield of async await",
    "typescript": "break case catch class const continue debugger default delete do else enum export extends finally for function if implements import in instanceof interface let new package private protected public return static super switch this throw try type typeof var void while with yield of async await abstract as declare from readonly",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while",
    "kotlin": "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while by catch constructor delegate dynamic field file finally get import init param property receiver set setparam value where actual abstract annotation companion crossinline data enum expect external final infix inline inner internal lateinit noinline open operator out override private protected public reified sealed suspend tailrec vararg",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "cpp": "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class compl concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while async await var dynamic",
    "swift": "associatedtype class deinit enum extension fileprivate func import init inout internal let open operator precedencegroup private protocol public rethrows return static struct subscript typealias var break case catch continue default defer do else fallthrough for guard if in repeat throw throws try where while as Any false is nil self Self super true async await",
    "scala": "abstract case catch class def do else extends false final finally for forSome if implicit import lazy match new null object override package private protected return sealed super this throw trait try true type val var while with yield",
    "php": "abstract and array as break callable case catch class clone const continue declare default die do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield",
    "ruby": "__ENCODING__ __LINE__ __FILE__ BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield",
    "shell": "if then else elif fi for in do done while until case esac function return break continue exit export local readonly unset shift echo",
    "lua": "and break do else elseif end false for function goto if in local nil not or repeat return then true until while",
    "elixir": "after alias and case catch cond def defcallback defdelegate defexception defguard defguardp defimpl defmacro defmacrop defmodule defoverridable defp defprotocol defrecord defstruct do else end false fn for if import in nil not or quote raise receive require rescue return super throw true try unless unquote unquote_splicing use when with",
    "dart": "abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export extends extension external factory false final finally for Function get hide if implements import in interface is late library mixin new null of on operator part required rethrow return sealed set show static super switch sync this throw true try type typedef var void when with while yield",
    "r": "if else repeat while function for in next break TRUE FALSE NULL Inf NaN NA NA_integer_ NA_real_ NA_complex_ NA_character_ return",
}
# Words in capitals, and those of them also known in small letters.
SQL = "SELECT FROM WHERE AND OR NOT INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE DROP ALTER ADD COLUMN PRIMARY KEY FOREIGN REFERENCES INDEX UNIQUE NULL DEFAULT CONSTRAINT JOIN LEFT RIGHT INNER OUTER ON GROUP BY ORDER HAVING LIMIT OFFSET AS IN EXISTS BETWEEN LIKE CASE WHEN THEN ELSE END BEGIN COMMIT ROLLBACK TRANSACTION VIEW TRIGGER FUNCTION PROCEDURE RETURNS RETURN IF IS DISTINCT ALL ANY UNION EXCEPT INTERSECT WITH RECURSIVE"
SQL_ONLY_CAPITALS = "COLUMN PRIMARY KEY FOREIGN REFERENCES INDEX UNIQUE DEFAULT CONSTRAINT TRANSACTION VIEW TRIGGER FUNCTION PROCEDURE RETURNS RETURN IF INTERSECT RECURSIVE"
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
KEYWORDS["sql"] = frozenset(SQL.split()) | {w.lower() for w in SQL.split() if w not in SQL_ONLY_CAPITALS.split()}

# The words that introduce a function.
FUNCTION_WORDS = {
    "go": {"func"}, "python": {"def"}, "javascript": {"function"}, "typescript": {"function"}, "kotlin": {"fun"}, "rust": {"fn"}, "swift": {"func"},
    "scala": {"def"}, "php": {"function"}, "ruby": {"def"}, "shell": {"function"}, "sql": {"FUNCTION", "PROCEDURE", "function", "procedure"},
    "lua": {"function"}, "elixir": {"def", "defp", "defmacro", "defmacrop"}, "r": {"function"},
}
# The words a line of imports begins with.
IMPORT_WORDS = {
    "go": "import package", "python": "import from", "javascript": "import", "typescript": "import", "java": "import package", "kotlin": "import package",
    "scala": "import package", "swift": "import", "dart": "import export part library", "csharp": "using namespace", "rust": "use extern mod", "c": "#", "cpp": "# using",
    "php": "use namespace require require_once include include_once", "ruby": "require require_relative load", "elixir": "import alias require use", "r": "library require source", "shell": "source",
}
IMPORT_WORDS = {k: frozenset(v.split()) for k, v in IMPORT_WORDS.items()}
IMPORT_MODIFIERS = frozenset("pub export public internal private static global".split())
# Operators of three and of two characters; all others are one character.
OPERATORS_3 = "<<= >>= ... <=> === !==".split()
OPERATORS_2 = ":= == != <= >= << >> -> => <- += -= *= /= %= && || ++ -- ** :: ?? ?. !. .= ^^ &^ |>".split()
# Quote characters that open a triple-quoted string.
TRIPLE_QUOTES = {"python": "\"'", "ruby": "\"'", "dart": "\"'", "elixir": "\"'", "kotlin": '"', "scala": '"', "swift": '"', "java": '"', "csharp": '"'}
