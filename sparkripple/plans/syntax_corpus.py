"""Made-up Java and Kotlin sources, one per part, in shapes that try the grammars, and what reading them finds.

In a shape's texts NAME is the part's class, PKG its package and ZED a type of its
own number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    lang: str
    text: str
    pkg: str = ""
    primary: str = ""
    imports: str = ""
    refs: str = ""
    dotted: str = ""
    decls: str = ""

    @property
    def ok(self) -> bool:
        return bool(self.primary)


SHAPES = [
    Shape(
        "java",
        """package PKG;
import java.util.*;
import static a.b.Util.helper;
import a.b.Base;
/** {@link Hidden} */
@Deprecated(since = "1")
public abstract class NAME<T extends Comparable<? super T>> extends a.b.Base<Arg> implements Map.Entry<T, List<int[]>> {
  private final Set<Map<String, ? extends Item>> items = new HashMap<>();
  enum Kind implements Named { ONE(1) { int n() { return 1; } }, TWO; Kind(int... n) { } }
  record Point(int x, @Ann Coord y) implements Shape { Point { if (x < 0) throw new Bad("NotMe {"); } }
  interface In extends One, Two { default void go() { } }
  @interface Mark { Class<?>[] value() default {}; }
  /* Hidden h; */ // Hidden h;
  Ret m(Par p) throws Oops { Object o = (Cast) p; if (o instanceof Pat q && q.ok()) return Call.make(Ref::new, x -> x >> 2); return (p); }
}
""",
        "PKG", "NAME", "java.util.*,static a.b.Util.helper,a.b.Base",
        "Arg,Bad,Base,Cast,Class,Coord,Comparable,Entry,HashMap,Item,List,Map,Named,Object,One,Oops,Par,Pat,Ref,Ret,Set,Shape,String,T,Two,a,b",
        "Map.Entry,a.b,a.b.Base", "NAME<Base.Entry;Kind<Named;Point<Shape;In<One.Two;Mark<",
    ),
    Shape(
        "java",
        """package PKG;
public sealed interface NAME extends ZED permits Left, Right {
  static String of(Object o) {
    String t = \"\"\"
        class Hidden extends Nothing { " ) }
        \"\"\";
    var n = switch (o) { case null -> 0; case Pair(int x, var y) when x > 1 -> x; case Dot d -> { yield 2; } case ONE, TWO -> 3; default -> throw new Odd(); };
    for (final Each e : all) outer: while (true) { try (Res r = open()) { break outer; } catch (IoA | IoB e2) { continue; } finally { n >>>= 1; } }
    class Local implements Own { { new Anon() { Made m; }.run(); } }
    List<String>[] a = new List[3], b = { };
    return t + (String) null + (n < 1 ? Outer.Inner.class : int[].class);
  }
}
final class Left implements NAME { }
non-sealed class Right implements NAME { }
""",
        "PKG", "NAME", "",
        "Anon,Dot,Each,Inner,IoA,IoB,Left,List,Made,NAME,Object,Odd,Outer,Own,Pair,Res,Right,String,ZED",
        "Outer.Inner", "NAME<ZED;Local<Own;Left<NAME;Right<NAME",
    ),
    # Brackets close, but a parameter has no name.
    Shape("java", "package PKG;\npublic class NAME extends ZED { public void broken(int) { } }\n"),
    Shape("java", "package PKG;\npublic class NAME { public void broken(\n"),
    Shape(
        "kt",
        """@file:JvmName("NAMEUtils")
package PKG

import a.b.Other as O
import a.c.*

@Tag
data class NAME<T : Bound>(val p: Par?, private val q: a.d.Deep = make()) : ZED(1), Face<T> by p where T : More {
    /* nested /* Hidden */ comment */
    val s = "${list.map { x: Elem -> "inner ${x as Cast}" }} $Hidden"
    companion object { class Inside : Hold() }
    companion object Named : Mark
    enum class Kind(val n: Int) : Code { ONE(1), TWO(2) { override fun f() = 1 }; }
    fun <R> Recv.ext(f: suspend Scope.(Arg, Int) -> R): Map<String, out R>? = when (val v = f) {
        is Pat -> call<Made>(v, ::Hidden)
        !in Hidden.all -> object : Anon(), Other { val z: Deep? = null }
        else -> throw Hidden()
    }
}
""",
        "PKG", "NAME", "a.b.Other,a.c.*",
        "Anon,Arg,Bound,Cast,Code,Deep,Elem,Face,Hold,Int,JvmName,Made,Map,Mark,More,Other,Par,Pat,R,Recv,Scope,String,T,Tag,ZED",
        "a.d.Deep", "NAME<ZED.Face;Inside<Hold;Named<Mark;Kind<Code;ONE<;TWO<",
    ),
    # No class: the file's facade is its type; the package isn't the path's.
    Shape("kt", 'package other.PKG\n\nfun top(x: List<Item>): ZED? =\n    x.firstOrNull()\n        ?: """raw "quotes" ${x}"""\nval c = \'}\'\n', "other.PKG", "NAMEKt", "", "Item,List,ZED", "", ""),
    Shape("kt", "package PKG\n\nobject NAME : Marker {\n    val x = listOf(1,\n        2)\n    private fun go() { return }\n}\nfun interface Run { fun run(a: ZED) }\n", "PKG", "Run", "", "Marker,ZED", "", "NAME<Marker;Run<"),
    # Brackets close, but a type is missing.
    Shape("kt", "package PKG\nclass NAME { val x: = 1 }\n"),
]


def sorted_names(names: str) -> str:
    return ",".join(sorted(filter(None, names.split(","))))


def picked(values: list[str], simple: Column, pkg: Column, k: Column) -> Column:
    text = F.element_at(F.lit(values), (k % len(values) + 1).cast("int"))
    return F.replace(F.replace(F.replace(text, F.lit("NAME"), simple), F.lit("PKG"), pkg), F.lit("ZED"), F.concat(F.lit("Zed"), k.cast("string")))


def files(classes: DataFrame) -> DataFrame:
    """(path, content) of classes(k, pkg, simple)."""
    k, simple, pkg = F.col("k"), F.col("simple"), F.col("pkg")
    folder = picked([{"java": "src/main/java/", "kt": "src/main/kotlin/"}[s.lang] for s in SHAPES], simple, pkg, k)
    path = F.concat(folder, F.replace(pkg, F.lit("."), F.lit("/")), F.lit("/"), simple, F.lit("."), picked([s.lang for s in SHAPES], simple, pkg, k))
    return classes.select(path.alias("path"), picked([s.text for s in SHAPES], simple, pkg, k).alias("content"))


def expected_sql() -> str:
    """What metadata finds in the files, over a view cv_class(k, pkg, simple)."""

    def of(values: list[str]) -> str:
        listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        return f"replace(replace(replace([{listed}][k % {len(values)} + 1], 'NAME', simple), 'PKG', pkg), 'ZED', 'Zed' || k)"

    folder = of([{"java": "src/main/java/", "kt": "src/main/kotlin/"}[s.lang] for s in SHAPES])
    columns = {
        "path": f"{folder} || replace(pkg, '.', '/') || '/' || simple || '.' || {of([s.lang for s in SHAPES])}",
        "parse_ok": f"{of([str(s.ok) for s in SHAPES])} = 'True'",
        "pkg": of([s.pkg for s in SHAPES]),
        "primary_type": f"nullif({of([s.primary for s in SHAPES])}, '')",
        "imports": of([s.imports for s in SHAPES]),
        "refs": f"array_to_string(list_sort(string_split({of([s.refs for s in SHAPES])}, ',')), ',')",
        "dotted": of([s.dotted for s in SHAPES]),
        "decls": of([s.decls for s in SHAPES]),
        "jvm_name": f"{of([str('@file:JvmName' in s.text) for s in SHAPES])} = 'True'",
    }
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM cv_class"


def shown(meta: DataFrame) -> DataFrame:
    """Metadata in the columns of expected_sql()."""
    imports = F.transform("imports", lambda i: F.concat(F.when(i["is_static"], "static ").otherwise(""), i["name"], F.when(i["is_asterisk"], ".*").otherwise("")))
    decls = F.transform("type_decls", lambda t: F.concat(t["simple_name"], F.lit("<"), F.array_join(t["supertypes"], ".")))
    return meta.select("path", "parse_ok", "pkg", "primary_type", F.array_join(imports, ",").alias("imports"), F.array_join("type_ref_simple", ",").alias("refs"), F.array_join("type_ref_dotted", ",").alias("dotted"), F.array_join(decls, ";").alias("decls"), "jvm_name")
