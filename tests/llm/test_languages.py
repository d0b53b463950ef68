"""Texts of the three languages that are valid as a whole, and statements that are not."""

import pytest

from cairn.llm.languages import judge

VALID_C = r'''
#define X(a) a
typedef int (*cb_t)(void *, int);
typedef struct node { int v; struct node *next; } node_t, *node_p;
static const struct foo bar[] = { { .a = 1, .b = { 2, 3 } }, [5] = { 4 }, { sizeof(int), (x) + 1, -1 } };
enum e { A = 1, B, C = A | B, };
extern int printf(const char *fmt, ...) __attribute__((format(printf, 1, 2)));
int old(a, b) int a; char *b; { return a + *b; }
static inline unsigned long long f(void) { return 3ULL << 4; }
struct bits { unsigned a : 3, b : 5; int : 0; };
int (*fp[3])(int) = { 0 };
DEFINE_THING(name, 3)
MODULE_LICENSE("GPL");
static int g(int n, char *p) {
    int i, *q = &n, arr[10] = { 0 }, m[2][3];
    node_t *x = (node_t *)malloc(sizeof *x), y = { .v = 1 };
    unsigned const char *s = "a" PRIu64 "b" "c";
    for (i = 0; i < n; i++, q++) if (*q == '\'' && !p[i]) continue; else break;
    do { n -= 2; } while (n > 0 && x->next->v != 3);
    switch (n) { case 1: case 'a': n = 2; break; case 3 ... 5: { n++; } break; default: goto out; }
    while (*p++ = *s++) ;
    list_for_each_entry(x, head, list) { x->v = n ? : 3; }
    n = n > 3 ? -n : ~n & 0x1f;
    n = (int)3 + (long)n * -*q;
    p = (char *) { 0 };
    ((void (*)(int))p)(3);
    fp[1] = &old; (*fp[0])(1);
    x->cb(a, b)->c.d[3] += 4 % 2;
    --n; ++*q; !n; -n;
    __asm__ volatile("mov %0, %1" : "=r"(n) : "r"(i) : "memory");
    n = ({ int z = 3; z; });
    static_assert(sizeof(int) == 4, "x");
    struct foo z; struct foo *w = &z; enum e k = A;
    UNUSED(n);
    EXPORT_API foo_t bar = 3;
    return n == 1 || (n >= 2 && n <= 4) ? n : -1;
out:
    free(x);
    return;
}
'''
VALID_CPP = r'''
#include <x>
namespace a::b { inline namespace v1 { } }
using std::vector; using P = int *; using F = void (*)(int); using namespace std;
template <typename T, typename = std::enable_if_t<std::is_integral<T>::value, int>> class Q;
template <class T, std::enable_if_t<(sizeof(T) > 4), int> = 0> T f(T &&t) noexcept(true) { return std::forward<T>(t); }
template <typename... A> auto g(A &&...a) -> decltype(h(a...)) { return h(std::forward<A>(a)...); }
template <> struct S<int *> : public Base<int, 3>, private Other { int x = 3; int y{4}; static constexpr int z = 1 << 3; };
enum class E : uint8_t { A = 1, B };
class [[nodiscard]] K final : public B<K> {
public:
    explicit K(int a = 3) : a_(a), b_{a, 2}, c_(new int[3]{1, 2, 3}) { init(); }
    K(const K &) = delete; K &operator=(K &&o) noexcept = default; virtual ~K() = 0;
    bool operator==(const K &o) const { return a_ == o.a_; }
    operator bool() const { return a_ != 0; }
    int operator()(int x) const { return x; } K &operator++() { ++a_; return *this; }
    template <typename U> void m(U u) const & { this->template n<U>(u); }
    friend std::ostream &operator<<(std::ostream &os, const K &k) { return os << k.a_ << "x" << 'c' << std::endl; }
    virtual void v() override final;
protected:
    mutable std::mutex mu_; std::map<std::string, std::vector<int>> map_; std::unique_ptr<K> p_ = nullptr;
    int a_ : 3; unsigned b_ = 0x1'000;
private:
    void (K::*pm_)(int);
};
K::K(int x) : a_{x} {}
template <typename T> void K::m(T t) const & {}
auto l = [&, x = 3](auto a, int b = 2) mutable -> int { return a + b; };
constexpr auto operator""_kb(unsigned long long v) { return v * 1024; }
extern "C" { int c_fn(void); }
extern "C" int c2(int a);
int main(int argc, char **argv) try {
    auto [a, b] = std::pair{1, 2}; const auto &r = v[3]; auto *p = new T(3); auto *q = new T[4]; int &&rr = 3;
    for (const auto &[k, v] : map) { std::cout << k << v; }
    for (int i = 0; i < 3; ++i) if (auto it = m.find(i); it != m.end()) return it->second; else throw std::runtime_error("x" + s);
    std::vector<std::pair<int, int>> x{{1, 2}, {3, 4}}; std::array<int, 3> arr = {1, 2, 3};
    auto y = static_cast<int>(x.size()) + 3 * -2; auto z = a ? b : c < d ? e : f;
    std::sort(x.begin(), x.end(), [](const auto &l, const auto &r) { return l.first < r.first; });
    switch (e) { case E::A: break; case E::B: { foo(); } default: bar(); }
    if constexpr (sizeof...(A) > 0) { } else if (not a and b or c) { }
    while (true) { do { x++; } while (x < 3); }
    delete p; delete[] q; (void)a; *p = 3; &x; ~y; ::foo(); std::move(x).y().z; obj.*pm; (obj->*pm)(3);
    co_await foo(); co_return 3; throw; label: goto label;
    int arr2[3][4] = {{0}}; std::function<void(int)> fn; unsigned long n = 3ul; T<int>::type t; typename T::x u; x = y = 3; x <<= 2; a <=> b;
    using X = T<Y *>; static const char *const names[] = {"a", "b"}; foo<3>(4); foo<a, b>::c = 3; return 0;
} catch (const std::exception &e) { return 1; } catch (...) { return 2; }
template <typename T> concept C1 = requires(T t) { t.x(); };
template <C1 T> requires (sizeof(T) > 3) void con(T t);
'''
VALID_GO = r'''// x
//go:build linux
package main

import (
	"fmt"
	m "math"
	_ "embed"
)
import . "os"

const ( A = iota; B; C )
const x, y = 1, "a"
var z = map[string][]int{"a": {1, 2}, "b": nil}
var ( e error; w = struct{ a int }{3} )
type T struct { a, b int `json:"a"`; *Other; F func(int) (string, error); m map[string]interface{}; c chan<- int }
type I interface { M(int) error; ~int | ~string }
type G[K comparable, V any] struct { k K; v V }
type A1 = T
func (t *T) M(a, b int, c ...string) (n int, err error) {
	defer func() { if r := recover(); r != nil { err = fmt.Errorf("x %v", r) } }()
	if x := f(a); x > 0 && !t.ok || a == -b { return x, nil } else if y { return } else { a++ }
	for i := 0; i < len(c); i++ { continue }
	for i, v := range []string{"a", "b"} { _ = i; _ = v }
	for range ch { break }
	for { select { case v := <-ch: use(v); case ch <- 3: default: return } }
	for k := range map[string]int{"a": 1} { delete(m, k) }
outer:
	for a < b { for { break outer }; goto done }
	switch v := x.(type) { case int, *T: fmt.Println(v); case []byte: case nil: fallthrough; default: }
	switch { case a > 3: b = 2; case b&1 == 0: b &^= 3 }
	switch a := f(); a { case 1: }
	p := &T{a: 1, b: 2}
	q := []*T{{a: 1}, nil}
	arr := [...]int{1, 2, 3}
	mm := map[string]func(int) int{"a": func(x int) int { return x * 2 }}
	fn := func(a int) (b int) { return a + 1 }(3)
	go func() { ch <- 1 }()
	var v, u int = 1, 2
	var it interface{} = x
	const k = 3
	type loc struct{ a int }
	a, b = b, a
	a += 3; b <<= 2; *p = T{}; p.a, p.b = 1, 2; (*p).a = 3
	s := arr[1:2]; s = append(s, arr[:]...); r := s[len(s)-1]
	g := G[string, int]{k: "a", v: 1}; h := Map[int, string](xs, f); t.F(3).(error).Error()
	x := <-ch; y, ok := <-ch; z := -x ^ y | 3; w := !ok; c := 'a' + "b"[0]
	if err := func() error { return nil }(); err != nil { panic(err) }
	if v, ok := m[T{1}.a]; ok { }
	return 1, errors.New(
		"x",
	)
done:
	{ a := 1; _ = a }
	return a, nil
}
func gen[T any, U ~int](t T, u ...U) map[string]chan struct{} { return make(map[string]chan struct{}) }
func ext(a int) int
func one() int { return 1 }
func two() func(int) (int, error) { return func(a int) (int, error) { return a, nil } }
func three() (a interface{ M() }, b struct{ x int }) { return }
func init() {}
'''


@pytest.mark.parametrize(("text", "language"), [(VALID_C, "c"), (VALID_CPP, "cpp"), (VALID_GO, "go")])
def test_valid_texts(text, language):
    for t in (text, text.replace("\n", "\r\n")):
        assert judge(t, language) == ("valid", -1)


BODY = {"c": "int f(int a) {{ {} }}\n", "cpp": "int f(int a) {{ {} }}\n", "go": "package p\n\nfunc f(a int) {{ {} }}\n"}


@pytest.mark.parametrize(
    ("statement", "languages", "at"),
    [
        ("foo bar baz + ; 3 4 5;", ("c", "cpp"), "+"),
        ("x y z 1 2 + *", ("go",), "y"),
        ("a = 3 4;", ("c", "cpp", "go"), "4"),
        ("a = b + ;", ("c", "cpp", "go"), ";"),
        ("a = b / / c;", ("c", "cpp", "go"), "/ c"),
        ("a b / c;", ("c", "cpp"), "/"),
        ("a 3;", ("c", "cpp", "go"), "3"),
        ("f(a, 3 4);", ("c", "cpp", "go"), "4"),
        ("f(a, b 4);", ("c", "cpp", "go"), "4"),
        ("if { a++ ; b(", ("c", "cpp"), "{ a"),
        ("for i := 0; i < 3; i++ a {", ("go",), "a {"),
        ("a := b c", ("go",), "c"),
        ("return a b", ("go",), "b"),
        ("if a { b } c { d }", ("go",), "c {"),
    ],
)
def test_statements_that_fail(statement, languages, at):
    """The failing token is the exact one."""
    for language in languages:
        before, after = BODY[language].format("\0").split("\0")
        verdict, offset = judge(before + statement + after, language)
        assert (verdict, offset) == ("broken", len(before) + statement.index(at)), language
