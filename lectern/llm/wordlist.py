"""Ordinary words, most common first: the 5,000 in most files among the docstrings and comments of a Python installation."""

WORDS = """
the for this and with not see use license copyright you that from all return are when one returns can only may python
file used will type set which more true software default version any but list name class value should string also none
check either copy get have function data object under using has first given information each code number like same
specific other note here work values there required into must create false then example additional otherwise these
licensed optional unless except need module method some case new add because its whether ignore does error after make
pygments was import parameters call non language where before since obtain instead input than support they distributed
writing present tuple details without functions convert names single instance empty source types output apache both int
applicable argument two defined format called always result just time licenses path raise order specified user index
avoid out permissions contributor end them implied foundation express limitations based compliance found passed such
examples methods dict law agreed already governing returned remove line self objects regarding try arguments ownership
raises valid agreements current exception strings would handle match start want contains different last array following
multiple base find now read uses bool between key most run been github possible needed provided text available
implementation cannot generated args pass attribute sequence length back could part special even level defaults allow
size standard test noqa parameter original directly containing over their reserved through mapping attributes integer
being form point dictionary how supported while change ensure files about means column created our raised added
currently keep encoding style team another classes write include once what below way might parse keyword float above
character compatibility rights table per right still bytes common reference message contain those calls else generate
cases process via spark issues pandas equivalent model numpy necessary options replace well block keys characters during
useful calling corresponding expected internal update including local determine left take second sure deprecated element
errors variable skip invalid notes removed within boolean next done extra context mode warning elements every map build
callable provides until root allows apply provide least never public override sets automatically simple union compute
columns specify state zero behavior existing series setting later explicitly func directory interface item off supports
binary takes too allowed instances library maximum param similar etc itself load missing needs attr representation cache
package usage were full running field lines dtype versionadded however arg exists requires actually many results
converted open numbers equal memory written shape versions assume subclass tuples custom rather system cover lexer main
logic windows actual matches checks correct protocol long matching unicode exist microsoft stored range def ignored
nothing place variables content split docs named top pragma anything old access fields inside items option store
operation row works entry look future helper inputs documentation passing position something bit define due own around
expression issue less relative represents save constructor control makes buffer built cast hypothesis underlying
returning scalar construct count log prefix exceptions corporation creates node show better checking gets modify regular
against parent print fail handling header times info iterable lists mozilla operations related sort appropriate group
unique included includes users attempt representing validate know resulting your normal perform known wrapper yet close
nested performance very wrap integers location safe compatible individual arrays fails metadata fixed made namespace
terms tests parsing conversion generic command starting syntax alias extension implement implemented keywords please
possibly subclasses according assignment numeric previous real large environment final operator search target applied
pattern whitespace changed depending exactly require rows considered creating negative again byte global sys changes
configuration indices label kwargs side extract space whose datetime display iterator initial modules offset adding
basic flag trailing complete explicit indicates treated filter signature arbitrary lower complex filename listed entries
happen lexers contents enable limit null stream parsed prevent testing three date identifier small width handles loop
raw therefore backwards handled property shared usually comment longer ndarray private probably represent operators
points reading stop though cause literal particular pre request mypy general minimum references runtime section separate
sorted whole calculate consider encoded pyspark sub appear axis caller comparison double everything incompatible reset
various compare replaced total associated put append comments definition entire register specifies decimal much detect
fall fast installed properties select along codec having leading adds fallback initialize move ones pairs produce
traceback backward paths taken thread absolute best connect give mark algorithm collection difference insert precision
subject break desired doing faster generator happens max processing ref specifying starts thus accept indicating let
random server unknown converts pair project schema checked encodings making simply across correctly disable failed multi
outside short accepts foo implements indicate closed frame parts really wrapped connection decoding execution fill
requested supplied tree clear modified things constant effect help manager preserve together config distribution dtypes
messages remaining typically able enough follows likely positive yield builtin exclude mask structure accepted beginning
nodes platform constants core fix imported positional query escape gives ordered parser validation certain condition
intended kind obj stack encode going rest decorator doctest drop further git headers mean previously requests unlike
behaviour graph meth optionally slice token treat window cached event addition normalize send step timestamp words
abstract imports runs typing depends hash reason refer response bound force formatted immediately rules session verify
console dev expect infer looks seconds separated applies assumed down floating good internally labels others turn
updated authors determined enabled body exact fully lambda meaning release sequences defines features greater loaded
maps occur spaces child contained converting followed lookup aliases bar blocks catch decode delete doc ensures ints
larger compiler description expressions leave report resolve view assert docstring external had handler iterate
iteration regex temporary versionchanged copies inference pip sum working copied evaluate fit packages plain alternative
color duplicate flags guaranteed stable follow forward generally important legacy normally overridden recursively
relevant script strip subset track trying contributors engine hold low permission several higher outputs separator
switch wrong feature newline normalized occurs pull recent registered represented tools warnings document formats merge
record specification batch formatting install speed strict categorical come computed dataset described descriptor ends
execute misc application assumes hook min older potentially properly tag transform word arrow consistent convenience
disabled few floats high manually socket did functionality indexing native problem purpose client restore setup collect
creation dimension exit holds inferred models reads tokens unchanged codes got join looking wait become ordering
produced scalars selected utf bin bits bug deal derived finally link counts earlier extensions kept maybe neither spec
suitable assigned direct host recursive reduce sample directories proper round address appended arithmetic bounds
generates groups pytest semantics formatter inner matrix optimization params repeated scheme seems statement unit
account buffers compared identical interval pickle purposes replacement resolution reverse share smaller terminal why
assign callback clean compiled determines domain google importing json often pretty printed processed program reasons
slow unix vector branch components digits inspect levels prior readable settings url avoids care expects free indexes
period scope suffix thing timeout conditions executed nan plus recommended sent skipped bugs export failure highlight
machine pyarrow pydantic requirement retrieve status taking updates utility anyway axes choose combine continue hashable
mixed optimized overrides performed quoted repr responsible tell weights dataframe easy identifiers matched respectively
saved sometimes static unused wraps yields char combination early hence interpreted literals post systems tensor
assuming aware dimensions keeps raising reshape struct tags third timezone warn weight comma deleted linear notice
omitted padding port summary timedelta unsupported wrapping component efficient enum extended fine frequency linux
loading member overwrite reached regardless streaming title tries writes allowing amount auto categories compat
computing container guess nor render reuse seen sorting wise active blob changing definitions deprecation dimensional
implementing overflow passes rule although attention category children collections constructed duplicates initialized
major past serialized subsequent upper accessed broken causes comes cross defining depend dicts expensive factory
getting mapped mod preserved problems received requirements sizes adjust applying becomes calculated chunk invoked java
prefer proxy wiki appears bad building chosen controls day debugging dot dynamic inverse math positions preferred quotes
records successfully supporting whenever annotation cpython dependency dependent ever inherit languages lib quite
specifically twice upon annotations closing dependencies distinct embedded escaped generating hard latest limited opened
patterns replaces selection separately throw workaround dummy far hack outer protobuf scale silently trigger approach
breaks computes easier evaluated expand generation identify marked members power reader shown threads typed blank dates
disk encountered equality experimental fact ignoring minimal partition platforms printing product say training collected
construction corresponds edge figure logical marker ops origin overhead produces rank sense shows signal started
strategy stuff action almost away designed device evaluation immutable improve inserted libraries network prepare
punctuation removes storage storing attempts background broadcast casting chunks commands configured debug dictionaries
dropped locations offsets opening prints quote receive recursion resolved transpose comparing filled latter lazy letter
pad ways zeros bare begin chain chars database decide developers discard especially events excluded four identity
incorrect insensitive largest merged obtained precedence rename term whatever annotated capture coding hit implicit
master meant moved partial pure rely statistics unexpected virtual align boundary combined consume dynamically extend
gencodec goes height inc interpreter invoke keeping logging newly priority processes propagate replacing resource turns
variant among choice circular compile computation dispatch filters initialization necessarily potential removing retain
smallest square themselves utilities var wheel caching differ forms helpers hex newlines repeat routines serialize
signed vectors depth dir draw highest indexed init numerical partitions performs providing shell symbol transformed vary
accessing big calculation comparisons concrete decoded failing filesystem finished matter mechanism meta places pool
safely structured bpo displayed emit ending entirely epoch excluding extracted hide little mostly overlap recognized
refers sentinel serialization shift sign sources undefined aligned builds decorated fraction links naive occurred onnx
parses pick placed plugin scripts states stores strictly tab template unsigned backed backslash box differences
distribute front giving handlers infinite inline instantiate interpret maintain middle optimize perhaps pop remote
resources slightly truncated untyped whereas year zone author consists constraints differently factor frames half magic
nice operate overload queue segment similarly symbolic timestamps writer affect ascii breaking coerce colors configure
consecutive days describing detected evaluates human idea interchange minor prompt seed sensitive stdout submit truncate
variance additionally alternatively arr builtins col combining compression cycle digit documented eventually guarantee
helps increasing indentation inherited lowercase originally overriding referenced registry satisfy statements behaves
boundaries cleanup copying correspond descriptors distinguish duplicated hooks idx independent inf kernel lengths lock
page presence remain stdlib styles torch unpack val algorithms api average concatenate contiguous falls fetch globals
hand ideally instantiated layout occurrence pylint pyright scan seem stripped symbols threshold usual visible beyond
bind consumed dataclass deep duration elsewhere equals filling flush indent interactive limits pipeline prevents pseudo
qualified successful supposed unnecessary verbose abc agreement attempting authentication bias caused completely
conditional constructs expanded explanation filtering finds fuse garbage governed groupby indexer ndarrays onto ranges
retrieved specifier steps tables trace usable ambiguous canonical careful consistency direction email exc filenames
guide indicator intermediate len markers month nullable respect says significant slower suite temporarily attach backend
binding colon distributions easily filtered infinity interpolation introduced iterating lead lowest metaclass mixin
modes nearest pos routine suppress thrown units validated wants aggregate attached booleans cost describe division
documents enables flattened grouped inclusive lemburg locale lost normalization predicate regression releases showing
shutdown simplify task terminated think transfer transformation alpha appropriately attrs caught convention detailed
executable executing expose fewer flatten hidden holding hostname ids locals marks probability reported retry separators
throws translate acceptable adapted alignment alive applications automatic bottom coordinates dealing differs divide
ellipsis emitted encoder estimate finding finish implicitly indicated layer mappings onnxruntime periods pickling
practice ready reasonable reduction remains rich saving sends site stderr subprocess updating worker writable act
addresses age candidate choices combinations decoder delay descending destination effort family held ignores image
initializer leaves mainly metrics modification notation parallel plugins pointer policy progress reject rendering
singleton solution someone soon streams technically tells tensors wide accessible aggregation analysis approximate ask
brackets convenient cython defer determining freq highlighting installation meaningful mix newer partially performing
prefixes preserves quantized respective sending somewhat sparse tasks turned unfortunately who world alone archive
ascending compliant constructing constructors coverage delimiter effectively escapes eval expressed flat frozen guard
increase initially inplace leaving omit prepend reports shapes subtract swap tested alternate behave closest cols
continuous download dump encodes exclusive finite font hint implies importlib insertion inspired lazily lets matplotlib
microseconds mutable overwritten party password patch pep populate reporting scipy shall shortcut situation slicing
structures subtype validator accuracy caches calculating center completed completion conflict continuation dataclasses
declaration describes failures head hello highlighted lot modifying packaging preserving programming proto rare
reconstruct redirect redundant released schemes shorter slices terminate unset wrappers auth batches callers commonly
connections counting declared defs detection disallow effective enforce fits fusion inserting joined located mismatch
percent provider push reach recognize relies renamed security simpler singular splitting typical widget advanced
appending atomic cell charset conform degrees dots effects flexible granted grouping instantiation intersection kinds
loads localhost loops manage manual markup measure multiplication occurrences pipe portion primarily recurse red
repository scala segments span strategies subclassing tabs tool tried wish zip allocated basis belongs builder conflicts
constraint deviation discussion editor hashes incomplete increment inherits initializes integration issuecomment mac
mimic mutate naming pickled populated quantile reduced reflect remember risk searching shallow sized splits symmetric
train transforms underscore white basically calculates cursor delimited delta detail docstrings essentially exported
exposed falling fixture functools hints history hours impossible invocation isinstance knows letters locally loss median
milliseconds operand ourselves parsers prefixed proxies quantization retained reversed setuptools squared subgraph theme
trick uppercase accessor anymore belong cells compares concat controlled converter covered driver forces formed
fractional fresh helpful hierarchical incorrectly minus multiline near numba observed overlapping parquet particularly
payload recommend reused rewrite sampling skipping sufficient super threading transformer validators waiting web weird
worth yes accurate actions alter answer area callbacks channel classmethod closes counter development drawn enter extras
fortran generators grammar grid hexadecimal htest internals minutes natural num pending pieces plan pointing prediction
primitive queries relatively remainder samples selects service shrink signatures slash stdin transformers triple
vertical views weighted anchor assignments beta blocking button callables cancel causing clause compressed connected
datatype datetimes downstream exceed flow hereby horizontal lookups masked matrices moment parents pathlib predictions
producing pypa race registration renderable resolving roughly selector sockets towards valued yielding accordingly came
coerced datasets design dim directives edit efficiency efficiently expansion identifying intervals introspection
iterations limitation loader multiply ndim odd peps primary quickly region responses screen sep simplified specialized
specifications success tzinfo unspecified upstream variants affected assertion attempted bins buffered candidates
captured coercion complicated conversions covers deferred deterministic distance ensuring evaluating excel exponent expr
fused integral issued job kwarg linked logger managed manner modifications moving namedtuple nesting nonzero
observations operating packed parametrized phase possibility preceding quantize reduces registers rendered restriction
rtype ser situations stay tempfile transition transport trim validates walk ahead anywhere arbitrarily backport baz
behind calculations calendar certificate cleared containers decision discarded discrete distutils fold folder framework
guarantees home identified indented initializers interfaces legal likes menu namespaces opposed people physical plot
pypi reorder repeatedly stopped stops sync temp week bases bold broadcasting chance checkers clients coefficient
coefficients compact concatenated concatenation concurrent consisting contact counted customize cycles dense digest
disables disabling dist dotted env estimator fragment illegal imaginary latin loc looked profile protected resolver
rolling rounded saves score sections selecting serializer servers sides signals specifiers stats substring succeed
translated transposed tricky undo unlikely verified yielded acts affects app casts cat complexity confusing contexts
coroutine correlation decimals delegate despite diff edges enforced expanding former gap getattr iff independently
instantiating invariant involved iterables live lose merging modern observation opset optimizer padded parentheses
partitioning pickles precise preference quick ratio receives rejected retrieves rounding skips sliced squeeze substitute
supply tracking treats triggered unsafe unwrap username verification bindings bitwise black clip cluster collecting
commit cumulative dateutil decorators drawing drive dropna editable entered extends facing friendly hopefully improved
interesting invoking keyed leads malformed matters nanoseconds obvious ordinary piece plotting products puts sanity semi
sorts specially unavailable understand uniform unions unittest unpacked adjusted aka analogous assumption async
bootstrap border cartesian catching central chunked clock consist cut declarations declare decodes dual environments
excludes exponential extracts fastpath floor folding hierarchy hour intentionally interpretation learn machinery
maintained mul nulls org pack percentage permitted polynomial posix prepared purely rate reductions reliable retries
searches sharing simplest suffixes supertype timezones tokenizer undocumented validating vars years abort achieve apple
approximation backslashes chained circuit classification compound compress considering consumers decreasing degree
delimiters dialog discovered displays doctests enabling endian exceeds executor exhausted exited exits fairly fee forced
formatters frequencies functional huge inserts interaction iterated jump lineno masks mock multipart partitioned
pathname percentile placeholder prepended printable projects protocols recorded relationship repeats rid satisfied
scaling serializable shrinking sig slot superclass trivial ufuncs unable unbounded underscores unpickling urllib void
wheels zones absent asked astype asynchronous asyncio bail blue bytearray capturing chang choosing classic comparable
conjunction consumer converters corner disallowed div drops extracting feed fitting histogram idle increases inheritance
intercept invokes iterators january labeled leak light longest management modifies operates play protect providers
putting quoting randomly rebuild reflected renders roots seq shorthand skipna startup suppose tkinter tolerance
treatment trees triggers upgrade urls weak whitespaces adjacent andre bother bounded bracket buffering clears
conflicting coordinate deliberately deprecate derive dropping equally existence exposes fitted folded freedom frequently
glob gmail historical hye inconsistent installs integrate listing mapper marc measured mess mirrors nans nature official
performant perky portions programs prune referred registering requiring runner satisfies seek shik stateful tail thought
turtle ufunc unary uniformly usr vectorized warsaw weakref accepting afterwards allocation analyze architecture avoided
await categoricals chaining checkpoint collector collects coming commas const convertible ctypes defaulting defensive
developer downloaded elementwise embedding escaping ext finder heuristic historically incoming installing kernels mal
merges normalizes ordinal preceded predicates proceed profiling prompts redirects refactor scaled searched serializing
shuffle six solely spaced spacing stackoverflow stage standalone straight stripping surrogate symlink symlinks teardown
tick timer tracebacks traditional universal unpacking validity varies verifying wikipedia worry ability advance allocate
altered avoiding backends blocked bools bypass checker cleaning composite configurations consumes conventions cpu
datetimelike dead deleting demonstrating destroyed directive divisor dog eagerly elif english estimation everywhere
executes exiting fredrik gather generics globally gone gradient gzip inferring initializing invalidate joining macro
managing met minimize monkey mutated mutually needing notebook octal opens operands overloaded person powers predict
propagated question rarely reaches readline resolves resultant robust safety scenarios schemas sessions shifted slots
solve stat stub submodule succeeds suppressed tagged theory tied timeouts trimmed trip unreachable wanted advantage
approximately archives braces carefully catalog clone codecs collapse correctness crash dark demand detects diffusion
displaying distinction draws enclosing equation err explained exports extending fake fashion fastest fixes forget
forwarded gaussian grab green happened hashing hope identifies individually intel iterates leaf leap logically manages
michael midnight minute miss mouse obtaining optimal optimizations orders parenthesis paste pearson pow principle
processor quantiles recently relying replacements representable reproduce rewind rightmost scales separating sequential
sphinx squares stacked statistical stopping structural submodules targets thanks translation truncating ugly warns
wildcard abs accesses accumulate alice animal appearance appends benchmark benefit branches browser carry cert click
compilation consumption covariance datatypes decides decorate dedicated denote diagnostic django emits encapsulates
ended evenly examine exec existed explain fancy fetched five fixtures frac goal happy impact importable indexers
inheriting inject justify late launch leftmost life logged logs magnitude maintains manipulation marking membership norm
offers okay oriented outcome overflows overview owner pages parity persistent predefined presented press prog reachable
reasonably receiving regexes reindex repeating res residual resume sampled scenario simplicity soft somehow spurious
strong subclassed subsequently suggested sunday swapped thousands transforming traverse trust unhashable utils whichever
accumulated activate alphanumeric angle assertions assigning backing barry begins bucket buf bytestring catches caution
certificates com combines complain conf cookie couple course customized ddof del descriptions diagonal difficult dirty
domains enclosed encounter endpoints entering errno exceeded explode fork formula frozenset giampaolo great greedy heads
hosts itemsize lack latency logistic mandatory mimics monotonically moves mutating mutation namedtuples nanosecond
narrow obsolete opt overall overwrites predicted promote quit recreate removal resets room ruff said sane sees
significantly spans subtraction surrounded treating unbound unmodified unnamed unregister varying vendored verbosity
versa vice visual waits weekday wire zstandard accidentally adapter annoying anyone ast besides boxes circumstances
classmethods confused cookies dash denotes density dims eager emulate endianness engines eps eric establish established
estimated exporting extremely fills fixing geometry heavily highlights httplib indirectly insensitively instruction
interrupt introduce invocations lacks lies localize lookahead man masking mathematical mentioned natively nicer numbered
opaque outfile parameterized patched persist pinned preparation primitives projection quality questions ranks reducing
referencing refresh refs refuse regexp relation req respected restricted rounds scanned schedule scientific shim
simultaneously somewhere speedup stray subdirectory substitution surprising templates ties timedeltas tokenize toplevel
tracks trusted typ uniqueness unrelated walking wider worked workers worse abbreviation adapt agent aggregating apart
barrier basename bob bunch cancelled cased casted cleaned clustering concepts conceptually conservative costly dance
dataframes debugger definitely deserialized dest differentiate dimensionality discarding discover downloads duplication
egg elapsed emitting epsilon equivalents expecting expired exposing externally face favor fed filepath finishes forcing
foreground generalized handshake highly hyphens ideal idempotent idlelib immediate increased incremented indirect
inexact inspection instructions intent irrelevant isolated iteratively joins klass learning lifetime locate micro modulo
monotonic normalizing obviously occurring opposite pearu peterson pid population ran readonly recover redirected
reindexing reraise restart restrictions satisfying scoped scores shifting signs sourcecode stale strips structs
succeeded throughout tip translates triples truth unclear unnecessarily unordered vertically wake wall widths wrote
zipfile zoneinfo achieved alongside alphabetically alt annotate assigns beware broadcasted bytecode cap capable
chunksize circle closer closure collisions complement concatenating cond confusion conn connecting consuming controlling
coroutines correspondence counterpart cuda dec deduplicate deeply demo deserialize discards dunder eliminate enumerate
estimates executors exp february fillna flaky fly footer fractions gamma graphs homogeneous hudson infers intact
integrated interact interpolate jython keepdims lexical linenos literally localized locks logits lundh macros maximal
meet memoryview miscellaneous mistake mixing monday namely net numerically oct oldest owns permit pointed pretend ravel
recipes recompute rejects reliably reload resample responsibility restored scanning sensible serializes shortest
spelling stacking stages staticmethod strange strides subdirectories subtle supplying surrounding threaded timing
tracing transitions triggering truncation understood unhandled unlimited visibility wild writeable xdist xref yourself
abstraction acquire algebra apparently argparse aspects auxiliary bars bootstrapping browsers bundle carries cheap
closely compressor configurable configuring continuations contract contrary criteria curve dashes daylight declaring
deepcopy derivative descendant desirable desktop developed discouraged discovery dividing doyle enters europe falcon
freeze frequent furthermore gateway guessed handy heap holes images imply incremental interfere italic jobs john lambdas
listlike lives lots lowercased managers manipulate mechanisms metric micahel mirror mismatched modifier mon multiplied
notable omitting opcode opcodes paired paper patching pin popped preprocessor quant querying reaching referring renaming
reordered replay reshaped respects revised rewriting seeing semantically setter shot solaris spam spearman specs
stacklevel standards star stricter strongly substrings subtracting summarize terminates texts textual thereof thresholds
timeseries told trained transaction truncates unambiguous unrecognized unusual upcast useless util van verifies
virtualenv abbreviations aggregations alert aliased aligns ambiguity arch bogus book borrowed business canvas
capitalized captures clearly coded codepoint companion completes compose comprehension computations conforms
contextmanager continues contrast contributed conv credentials critical decomposition deletes denominator denoted desc
descriptive destroy dialect dispatches ditto divided downcast duck editing endpoint enhanced entity evaluator existent
fetching finalization flushes fonts forever fourth fragments gain geometric graphics hits informative interested
internet introduces introspect invert iso jupyter knowledge lang lex linearly mail maintaining march mat merely
microsecond multiples myself notify offer oudkerk overloads overwriting pairwise parrot perf perfect picklable pivot
plane plots portable possibilities problematic procedure pyproject refactoring repetitions reshaping resize rewritten
roll scheduled scopes sdist secret secure semantic separates serve serves shadow shebang simulate sleep stands strftime
substituted subtypes suggest summation targeted termination titles traversing unbiased underline unified uninstall
uniquely unstack uri vendor verbatim vim vinay visit widgets wins worst absence accumulator additions aggregated agree
aliasing alternatives analogue analyzed cancellation capability casing ceil claim communication composed concept
conforming conftest considers cores decided deeper defaulted dirname discriminator divmod dont durations easiest
encoders enums extraction factors ffill flip flushed focus forbidden futures gaps gelu gpu grouper growth guards guido
hardcoded hardware hasattr hiding hive huggingface improvement inclusion indication inlined innermost interest
interpolated interprets interrupted involving jan javascript layers likewise linecache logo losing maxsize midx mixture
modifiers months nonexistent online outermost parallelism persistence pertaining picked polynomials popular ported
positives powerful practical presumably proc promotion pypy pytz queried quiet recording reflection requesting restores
retrieval revision roundtrip sajip scanner searchsorted selectors sentence silence sin spawn statistic stick subsets
substituting substitutions summed tabular toggle touch transparent turning typeshed udf uncompressed unescaped uniques
unpickled unwrapped upload uuid variation warm went abbreviated absolutely accounting accurately activated adapters
affecting agg allowable alphabet alternating anonymous april avg backtick belonging benchmarking bfill bird blanks boxed
bring budget buggy byteorder caption channels cheaper clusters coercing colons colormap commented concatenates concern
confirm consistently cyclic daemon databases decompress defaultdict delegates denoting dictates dirs dispatched doubles
duckdb embed endings equivalence expands expires fileobj filesystems finalizer flattens flavor flexibility fname
forwards friends gathered gotten grained highlighter hot hyphen identically improvements indeed indicators informational
injected inspecting ipython isin keyboard kill larson latex launched lenient listener listening lone losslessly mid
minimizes missed mtime nearly nonnegative nrows objective ought overlaps pasted patches peak pickleable poll pops
precisely preventing producer pruned pushed pycon pytorch quadratic quarter recognised recommendation redef restrict rev
rotate sec seealso setitem shortcuts sigma signifies similarity slashes solved solver stand stata statically styler
sufficiently sums switches syntactically sysconfig technique terminating throwing tox traversal trouble truthy uid uint
unaffected unequal unquoted unsqueeze unstable untrusted viewer vocabulary weighting whisper wildcards win accommodate
accounts activation adhere adjustment advertising aid alternately amounts ancestors anchored anchors android animation
ansi approximated armin arrange arraylike assembled associate assumptions atom attaches authenticate authorization
baseline basics batched behaviors believe browse buckets capabilities carriage centered certainly certs chains chrome
chunking clamp cleanly clearing clipboard comply computer concise confuse consequence contribute cov cow criterion
customization darwin debian decoders dedent defects deg degradation delayed deletion descendants descent digests
divisible draft edition eigenvalues emacs encounters equivalently essential estimators factorization feather flows
flushing foobar formerly freed gracefully greatest grey grow hadoop happening harder heading heavy heterogeneous
horizontally incrementally inefficient infinities initialise inspected intp introduction invariants involve involves
issuing iter iterative kendall labs linalg linking looping machines manipulating margin memo midpoint mimetypes mini
monitor monospace multiclass multiindex multiplying music nonempty notified notion offending opener organized outcomes
overly paragraph perl phrase pictures plural popup preferences prerelease printer probabilities prod production profiler
protection pruning publish quotient rational raymond readers reality recursing redefine redirection refactored reindexed
replicate reprs residuals ret retrieving reusable revert role sans scatter scheduling scrollbar shadowed shaped shares
sheet shrinks signedinteger snapshot spline stateless stuck subgraphs subplots substantial successive summarized sun
superset synonym terminals thinks ticks timed todo toward transient translating transmission triangular tutorial
ultimately unaltered unfortunate unpickle unpivot untouched unusable usecols vandermonde versus viewing violation
visited yellow zeroes accidental addr advancing aggregates america ancestor anti appearing architectures argmax asarray
asynchronously attacks augment autogenerated backtracking badly bert bigint binds brace branching bump bundled buttons
ceiling chebyshev chi chooses claims clash classifier clauses clever cmdline coerces collapsed collision complains
completions comprehensive conditionally confidence configs connects corrupt country covariant crashes curly deadlock
deals december decisions decrease deduced defect deficient delegation deltas determination devices doi downloading ease
east eat eggs eliminating embeddings encouraged enhance entities equiv evolving expat expectation exponentially
facilitate faithfully feeding finalize forbid forest getitem globalns grows hang hardcode harmless hashlib hides httpbin
identities incrementing initialised injection instant intention intentional interacting interactions inversion inverted
investigate isolate james junk killed leaked leftover lie lit localns locked logfire maintenance makefile marginally
markdown materialize measures medium meets memoize mind mismatches modeled monkeypatch netloc nogil noise notably noted
notification nowrap numexpr occasionally optimum orc orthogonal parametrize peer percentiles pickler pipes pixel
placeholders placement placing planned policies poorly positionally predictable preferably prepares preprocess
prereleases presentation propagates propagating proposed psutil publicity pyshell qualifier rationale rcond readability
realize rebuilding rec receiver reciprocal redirecting redistribution reentrant relational relations repetition
resampling resort respond restoring retaining retains rossum rotated safer secondary seeking selections semicolon
setattr shipped shrinker simplifies skew smoothing snippet softmax specialization speeds spread standardized stays stubs
styling subarray subparts suffixed suites symmetry syntactic tabsize templating tokentype tol tolist toolkit topics
tracked tracker truly ttype tunnel typecode typevars ubuntu undone unicodedata unify unmapped unparsable unpredictable
unquote unwanted unwrapping upcasting verb versioning windowing abfnrtv accumulations albeit algo alphabetical ant
argsort arise artifact artifacts asking asks assemble assembly autosummary band beam bear became becoming bitmap
blockwise bodies boilerplate boring boxplot breakpoint calibration card clashes classname clocks cloud cocoa compiling
concurrently consideration consolidate constrained consult contrib contributions conveniently correlations cosine crop
cumsum dangling deadline deemed demonstrates deque der derivatives die differing disallows discussed disks earliest
eastern eight einsum emscripten encodable encrypted entropy enumeration erroneously euclidean european ewm exclusively
executions exhaustive extraneous facilities fair fallbacks finders foreign forming forwarding freely frozensets fullname
getter glibc gotchas grep guessing guides hacky hood hostnames hugging icon idna ill impl infs installations
interactively intermediary intersect intuitive ish isna labeling launching letting lexicographic libc likelihood loaders
localization locator login mailbox manipulated mantissa matmul maximize meantime millisecond movement multiplicity
mutations narrowed narrowing netcat neural nocover nodeid nopython numerics observability octets offered onwards opts
orient overflowing overlapped papers paren parens penalty perfectly permanently pixels plotly pluggy pointless poor
prepending presents pressing promoted propagation published pydoc pythons pythonware qualname quartiles quotation
ranking recall recarray recognizes reconstructed rectangular redo refused regions regularization rejection relied
renderables reordering reraised rescale revisit rigo rmtree rotation roundoff sadly savings scripting seekable
semaphores separation serious serving settable seven shorten shrunk shutil signify silent simplejson sink snap spent
stylesheet subprocesses subtracted subtree sugar suspend switched synchronize syscall ten terminator thin tie toctree
took topological totally traces trade transparently travis turtles twisted tzdata uncomment uninitialized unsatisfiable
unsorted unstacked vals variations videos viewed visualization warned waste weekly weeks workbook xfail yanked abi
accelerate accumulation acquired acquiring adjustments agnostic altering alters answers anyways appeared argv arrive ary
asserts atexit augmented availability backfill backported backticks batching beforehand blindly blog blow breakpoints
brian broadcastable carried carrying caveats chart checkout checkpointed checkpointing checkpoints classify cleans cli
clicked cloned cloudpickle collectors compensate completing computational consequently contextual continued continuously
contributes correction ctype cube customizing dangerous dealt declares decompressed decompression decrement decremented
deduplicated delegated delegator derives designated detecting determinism differentiated disappear dispatcher
distinguishing divides doctype driven dumb dumps duplex duplicating echo
""".split()
