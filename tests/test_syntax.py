"""The readers of Java and Kotlin text: what they take, what they refuse, and what they find."""

import pytest
from sparkripple.functions import java_syntax, kotlin_syntax
from sparkripple.functions.reading import SyntaxFault
from sparkripple.functions.source_text import NOTHING, metadata_of

JAVA = [
    'class A<T extends B & C<? super D>> { int[] a = {1,2,}; List<Map<String,List<Foo>>> m = new HashMap<>(); }',
    'class A { void f() { for (int i=0, j=1; i<10 && j>>>2>=3; i++, --j) {} for (final var x : xs) ; int y = (int) -1; Foo z = (Foo) (a); boolean b = a < b && c > d; x >>= 2; x >>>= 3; q = a >> 3; } }',
    'class A { Runnable r = () -> {}; F g = (a, b) -> a + b; H h = (int a, final Foo b) -> { return a; }; S s = Foo::bar; T t = a.b.Foo::new; U u = int[]::new; V v = List<String>::size; W w = Foo[].class; X x = this::go; Y y = super::go; }',
    'sealed interface S permits A, B {} record A(int x, Foo<Bar>... ys) implements S { A { if (x<0) throw new E(); } static int z; A(int q) { this(q, null); } } non-sealed class B implements S {}',
    'class A { int f(Object o) { return switch (o) { case null -> 0; case Foo(int x, var y) when x > 0 -> 1; case Bar b -> { yield 2; } case X, Y -> 3; case Q.R -> 4; default -> throw new E(); }; } void g(int k) { switch (k) { case 1: case 2: h(); break; case A.B: x(); default: } } }',
    '@Ann(value = {A.class, B.class}, x = @In("y")) public final class A { @Deprecated(since="x") @Override public <T, U extends V> Map.Entry<T, U> m(@N final T t, int... q) throws E1, E2 { try (var a = b(); c) { } catch (final X | Y e) { } finally { } return null; } abstract int k()[]; @interface I { int v() default 3; String[] s() default {}; } }',
    'enum E implements F { A(1) { int z() { return 1; } }, @D B, ; private final int x; E(int x) { this.x = x; } } enum Z { P, Q } enum W {}',
    'class A { { int a = b instanceof Foo f && f.x() ? 1 : 2; if (!(o instanceof final Foo<?> g)) return; } static { x.<T>y().new Inner(1) { }; outer: while (true) { break outer; } do { } while (x()); assert a : "b"; synchronized (this) { } ; new Foo(){ }.run(); int[][] q = new int[3][]; String t = """\n  a "b" \\""" c\n"""; char c = \'\\\'\'; long l = 0xFFL + 1_000L + 0b101 + 1e-3f + .5; Foo.Bar[] z = new Foo.Bar[]{}; a.b.C.super.m(); } }',
    'package a.b; import static a.B.*; import java.util.*; import x.Y; ; class A { int yield; void f() { var x = 1; record R(int a) {} enum Q { A } interface K {} class L extends M {} int record = 3; String s = a + (b) + c; foo((Bar) x -> y); Object o = (A & B) () -> {}; b = c ? (d) : e; f = x ? y -> z : w; arr[i]++; i = j = k; } }',
    'open module a.b { requires x; exports y to z; }',
    '',
    '/* only */ // comment',
    '@NonNull package a;',
    'class A { public static <T> void f(T @B [] a, A this) { @SuppressWarnings("x") int q = 1; final int w; List<?>[] y; } }',
    'class A { void f(){ String s = String.valueOf(x).trim(); map.computeIfAbsent(k, __ -> new ArrayList<>()).add(v); var r = cond ? List.<String>of() : Collections.<A>emptyList(); return; } int x = a[0][1], y[] = {}; Class<?> c = int.class; Class<?> d = void.class; Object e = Outer.this.x; }',
]
NOT_JAVA = [
    'class A { public void broken(int }',
    'class A { public void broken(int) {} }',
    'class A { int x = ; }',
    'class A { void f() { a b c; } }',
    'class A { void f() { return 1 } }',
    'class A { void f() { if x {} } }',
    'clas A {}',
    'class A { void f() { a + b; } }',
    'class A extends {}',
    'class A { List<Foo x; }',
    'class A { void f() { foo(1,,2); } }',
    'class { }',
    'class A { void f() { try { } } }',
    'class A { "x" }',
    'import ;',
    'class A { int 3x; }',
    'class A { void f( { } ) }',
    'record R { }',
    'class A { void f() { switch (x) { foo(); } } }',
    'class A { # }',
    'class A { String s = "abc; }',
    'class A { void f() { else {} } }',
]
KOTLIN = [
    'package com.example\n\nimport com.foo.Foo\nimport com.bar.Bar as B\nimport a.b.*\n\nfun f(arg: Foo): Bar = TODO()\n\nclass Holder {\n val field: Foo? = null\n fun nested(): Map<String, Bar> = emptyMap()\n}\n',
    'open class Base\ninterface Marker\n\nclass Outer : Base(), Marker {\n class Inner : Base()\n companion object Named { const val K = 1 }\n companion object { class Nested }\n}\n',
    '@file:JvmName("CustomName")\n@file:[Suppress("x") Foo]\npackage com.example\nfun helper(): Int = 42\n',
    'class A<in T : Foo, out U>(private val x: a.b.C = D(), vararg y: Int) : B<T>(x), E by f, G where U : H {\n init { println("a ${b.map { "c ${d}" }} $e") }\n constructor(z: Int) : this(z, 1) { }\n var p: Int = 1\n  private set\n val q: String get() = "x"\n val r by lazy { S() }\n lateinit var t: T\n override fun <V> List<V>.ext(a: (x: Int, Foo) -> Unit, b: suspend Foo.() -> Bar?): V? where V : W { return null }\n}\n',
    'enum class E(val x: Int) : I { A(1) { override fun f() = 2 }, @D B(2), ; abstract fun f(): Int }\nenum class Z { P, Q }\nenum class W\nsealed interface S\ndata object O : S\nfun interface R { fun run() }\nannotation class An(val v: String)\n@JvmInline value class VC(val s: String)\ntypealias X<T> = Map<String, T>\n',
    'fun main() {\n val (a, b) = pair\n for ((k, v) in map) println(k)\n for (i in 0..<10 step 2) { continue }\n var x = if (a > b) a else b\n when (val y = f()) {\n  is Foo -> 1\n  !is Bar, in 1..2 -> { }\n  else -> throw E("x")\n }\n try { g() } catch (e: IOException) { } finally { }\n val z = obj as? Baz ?: return\n list.filter { it > 0 }\n   .map { x: Int, (p, q) -> x + p }\n   ?.let(::foo)\n do { } while (true)\n outer@ while (true) break@outer\n val o = object : Foo(), Bar { override fun f() {} }\n val l = fun(x: Int): Int { return x }\n foo<String>(1, *arr, name = 2) { }\n a[1] += 2; b++\n if (x < y && z > w) return@main\n return\n}\n',
    'val x = a\n  .b()\n  ?: c\nval y = 1 to 2\nval s = """a "quoted" ${x + "y"} \\ """\nval c = \'\\n\'\nval n = 0xFF + 1_000L + 1.5f + 1e3\nval k = Foo::class.java\nval m = String::length\nval f: (Int) -> Int = { it + 1 }\nval g = { a: Int, b: Int -> a + b }\n/* nested /* comment */ still */\nval h = x !in y && x !is Z\n',
    'class A {\n @Inject lateinit var x: Foo\n @get:Rule val r = Bar()\n private val a = 1; private val b = 2\n fun x() = when { a > b -> 1; else -> 2 }\n inner class B(c: Int)\n operator fun get(i: Int) = i\n fun data(data: Int) { data.foo(); val open = 1; open.bar() }\n suspend fun go() = coroutineScope { launch { } }\n}\nfun String?.orX() = this ?: "x"\nval Foo.bar: Int get() = 1\nfun a.b.C.d() {}\n',
    '',
    '// only\n',
    'fun f() = 1\n',
    'fun f() {\n if (a) b else if (c) d\n else e\n x = y\n val z = a?.b!!.c\n super<Base>.f()\n this@A.g()\n return if (x) 1 else 2\n}\nclass B : A by c {\n}\nfun <T : Comparable<T>> max(a: T): T = a\ninternal inline fun <reified T> q() = T::class\n',
    'fun f() {\n val o = object : Foo(), Bar { override fun f() {} }\n val l = fun(x: Int): Int { return x }\n val e = fun Int.(y: Int): Int = this + y\n foo<String>(1, *arr, name = 2) { }\n a[1] += 2; b++\n if (x < y && z > w) return@main\n return\n}',
    'class VM @Inject constructor(\n    private val repo: Repo,\n    @Named("x") val b: B,\n) : ViewModel() {\n    private val _s = MutableStateFlow<State>(State.Idle)\n    val s: StateFlow<State> = _s.asStateFlow()\n    fun go() = viewModelScope.launch {\n        runCatching { repo.get() }\n            .onSuccess { _s.value = State.Done(it) }\n            .onFailure { e -> _s.value = State.Err(e.message ?: "none") }\n    }\n    sealed class State {\n        object Idle : State()\n        data class Done(val x: List<Int>) : State()\n    }\n    companion object {\n        private const val TAG = "VM"\n        @JvmStatic fun of() = VM(Repo(), B())\n    }\n}\n',
    'class T {\n    @Test\n    fun `does a thing`() = runTest {\n        val x = mockk<Foo> { every { bar() } returns 1 }\n        assertThat(x.bar()).isEqualTo(1)\n        x shouldBe 1\n        verify(exactly = 1) { x.bar() }\n        assertThrows<IllegalStateException> { x.fail() }\n    }\n    @BeforeEach fun setUp() { }\n    @ParameterizedTest @ValueSource(ints = [1, 2]) fun p(i: Int) {}\n}\n',
    'val json = """{"a": ${x}, "b": "$y"}"""\nval q = "${if (a) "x" else "y"}"\nval cond = a in b && c !in d || e is F\nfun g(): String = buildString {\n    append("x")\n    for (i in 1 until 10) append(i)\n    while (i > 0) i--\n}\nvar z: Int\n    get() = field\n    set(value) { field = value }\nval lam: (String, Int) -> Unit = { s, _ -> println(s) }\nval pairs = mapOf("a" to 1, "b" to listOf<Int>())\nval r = x ?: throw E("a")\nval t = try { a() } catch (e: E) { null }\nval w = when (x) {\n    1, 2 -> "a"\n    in 3..4 -> "b"\n    is Foo, is Bar -> { "c" }\n    else -> "d"\n}\n',
    '@Composable\nfun Screen(vm: VM = hiltViewModel(), onClick: () -> Unit = {}) {\n    val s by vm.s.collectAsState()\n    Column(modifier = Modifier.fillMaxSize().padding(8.dp), content = {\n        Text(text = "a" + "b", style = x)\n    })\n    if (s) {\n        A()\n    } else {\n        B()\n    }\n    s.let { it as? Foo }?.also { println(it) }\n    val (a, _, c) = t\n    label@ for (x in xs) { if (x == 1) continue@label }\n    return\n}\ninterface I<out T> { val x: T; fun f(): T; fun g() {} }\nabstract class B<T>(open val x: T) : I<T> where T : Any { protected abstract fun h() }\n',
    'class A {\n  val a = b\n  fun f(x: Int?) = x!!\n  val l = listOf(\n    1,\n    2,\n  )\n  val neg = -1 + +2\n  val n = !a\n  val idx = a[0][1]\n  val c = A::class\n  val d = ::f\n  val e = a < b\n  val g = (a < b) == (c > d)\n  private fun h() = a.b<C>().d\n  init {\n    x = y\n  }\n}\n',
    'fun f() {\n    val x = a as Foo\n    val y = a as List<Foo>\n    x.y = z\n    (x as Bar).go()\n    { it }\n    return when {\n        a -> b\n        else -> c\n    }\n}\nfun <A, B> ((A) -> B).compose(x: A): B = this(x)\nfun (() -> Unit).run2() {}\nval (() -> Unit).p: Int get() = 1\n',
    'package a\nimport a.b\n\nfun f() { throw X() }\nexpect class P\nactual typealias Q = R\nval x get() = 1\nval a: Int = 1; val b = 2\nclass E : Exception("x")\nfun i(vararg xs: Int, f: Int.() -> Unit) = xs.forEach(::println)\nfun interface J { operator fun invoke(x: Int): Int }\n',
]
NOT_KOTLIN = [
    'fun f( = 1',
    'class A { fun f() { val x = } }',
    'fun f(a: ) {}',
    'fun f() { foo(1,,2) }',
    'class A : { }',
    'val x: Map<String = 1',
    'fun f() { "abc }',
    'fun f() { a b c d }',
    'class { }',
    'fun f() { if x { } }',
    'val s = "${a"',
    '/* open',
    'class A { foo }',
    'fun f() { try { } }',
    'val = 3',
    'fun f() { x = = 2 }',
    'import a.\n',
    'fun broken(a: Int',
    'fun f() { when (x) { 1 2 -> 3 } }',
]


@pytest.mark.parametrize("text", JAVA)
def test_java_is_read(text):
    java_syntax.read(text, "A.java")


@pytest.mark.parametrize("text", NOT_JAVA)
def test_broken_java_is_a_fault(text):
    with pytest.raises(SyntaxFault):
        java_syntax.read(text, "A.java")


@pytest.mark.parametrize("text", KOTLIN)
def test_kotlin_is_read(text):
    kotlin_syntax.read(text, "A.kt")


@pytest.mark.parametrize("text", NOT_KOTLIN)
def test_broken_kotlin_is_a_fault(text):
    with pytest.raises(SyntaxFault):
        kotlin_syntax.read(text, "A.kt")


def cut_short(texts, read):
    """How many proper beginnings of a text that end inside a bracket are taken for whole."""
    taken = 0
    for text in texts:
        for end in range(1, len(text), 7):
            part = text[:end]
            if part.count("{") > part.count("}"):
                try:
                    read(part, "A")
                    taken += 1
                except SyntaxFault:
                    pass
    return taken


def test_texts_cut_short_are_faults():
    assert cut_short([t for t in JAVA if '"' not in t], java_syntax.read) == 0
    assert cut_short([t for t in KOTLIN if '"' not in t], kotlin_syntax.read) == 0


def test_java_names():
    got = java_syntax.read("package a.b; class X extends q.Base<Arg> { Foo.Inner f; int[] n; T m(Par... p) { var v = (Cast) p; Other.call(this::go, Ref::new); return x < y ? Some.CONST : new Made[2]; } @Ann(Lit.class) void z() { } }", "X.java")
    assert got["type_ref_simple"] == ["Arg", "Base", "Cast", "Foo", "Inner", "Lit", "Made", "Par", "Ref", "T", "q"]
    assert got["type_ref_dotted"] == ["Foo.Inner", "q.Base"] and got["primary_type"] == "X"


def test_kotlin_positions():
    text = """package com.example

import com.foo.Foo

fun f(arg: Foo): Bar = TODO()

class Holder {
    val field: Foo? = null
    val x: com.example.foo.Deep? = null
    fun nested(): Map<String, Bar> = emptyMap()
}
"""
    got = kotlin_syntax.read(text, "References.kt")
    assert got["type_ref_simple"] == ["Bar", "Deep", "Foo", "Map", "String"] and got["type_ref_dotted"] == ["com.example.foo.Deep"]
    assert got["primary_type"] == "Holder" and kotlin_syntax.read("object Only", "Some.kt")["primary_type"] == "Only"
    assert kotlin_syntax.read("val x = 1", "some.kt")["primary_type"] == "someKt" and kotlin_syntax.read("object O\nclass C", "x.kt")["primary_type"] == "C"


def test_companions():
    got = kotlin_syntax.read("class A { companion object { class In } }\nclass B { companion object Companion : X }\nclass C { companion object Named : Y }", "A.kt")
    assert [(d["simple_name"], d["supertypes"]) for d in got["type_decls"]] == [("A", []), ("In", []), ("B", []), ("C", []), ("Named", ["Y"])]


def test_deep_and_long_texts():
    deep = "class A { int x = " + "(" * 3000 + "1" + ")" * 3000 + "; }"
    assert metadata_of("A.java", "java", deep) == NOTHING  # deeper than calls may nest here
    long = "class A { String s = " + " + ".join(['"x"'] * 20_000) + "; " + "void f() { if (a) b(); " + "else if (c) d(); " * 5_000 + "} }"
    assert metadata_of("A.java", "java", long)["parse_ok"]
    assert metadata_of("A.kt", "kt", "val x = " + " + ".join(['"x"'] * 20_000))["parse_ok"]
    assert not metadata_of("A.kt", "kt", None)["parse_ok"]
