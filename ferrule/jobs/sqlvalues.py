"""The fixed values as the expected results state them: a list of their own, so that a change in one place shows."""

# fixed values: words that carry no content
STOP = """
a an the and or but if then than that this these those is are was were be been being am do does did doing done have has had having i me my we our you
your it its of in on at to for with from by as about into over after before out up down off no not so such only own same too very can will just should
now please need want make made get got use used using help lets let s t d ll m re ve don didn doesn isn aren wasn weren hasn hadn haven won wouldn
couldn shouldn how what why when where which who whom whose whether any all some more most mine ours theirs here there thing things stuff way ways"""

# fixed values: words common in names
GENERIC = """
setup set configure config check fix build create add write run start stop update review audit code coding file files app apps project projects task
tasks work guide guides best practice practices pattern patterns tool tools skill skills agent new old good better simple quick full complete general
basic advanced custom default implement implementation feature features change changes issue issues problem problems"""

# fixed values: words without content in an intent
INTENT_STOP = """
the a an and or to for of in on how do i my me please can you is it this that with using use help need want get set out up down off from into onto
about after before over under again then when what which there here some any all be am are was"""

# fixed values: words that say how to work
MANNER = """
revamp overhaul enhance enrich improve polish upgrade refresh modernize aesthetic aesthetics design ux ui beautiful premium elegant better nice clean
tidy fix bugs issue issues"""

# fixed values: spelling variants
VARIANTS = """
postgres: postgres
postgresql: postgres
psql: postgres
pg: postgres
postgre: postgres
mongo: mongodb
mongodb: mongodb
k8s: kubernetes
kube: kubernetes
kubernetes: kubernetes
js: javascript
ts: typescript
py: python
python3: python
nextjs: nextjs
next.js: nextjs
node.js: node
nodejs: node
postgres.js: postgres
sqlite3: sqlite
mysql: mysql
mariadb: mysql
elixir: elixir
ecto: ecto
docker: docker
dockerfile: docker
github: github
gh: github
ci/cd: ci
cicd: ci"""

# fixed values: words of ecosystems
ECOSYSTEMS = """
python: python py pytest django flask fastapi pandas numpy uv pip poetry
javascript: javascript typescript node npm react next nextjs vue angular svelte tailwind
elixir: elixir phoenix liveview ecto beam otp oban mix
golang: golang go goroutine
rust: rust cargo crate
ruby: ruby rails gem
java: java spring kotlin maven gradle
csharp: csharp dotnet aspnet nuget
php: php laravel composer
swift: swift ios swiftui
postgres: postgres pgvector supabase neon timescale
mysql: mysql mariadb
mongodb: mongodb mongoose atlas
redis: redis valkey
sqlite: sqlite duckdb"""

# fixed values: concepts of what is typed
CONCEPTS = """
animate: animation motion
animation: animation motion
animations: animation motion
animated: animation motion
motion: animation motion
transition: animation motion transition
transitions: animation motion transition
easing: animation easing ease
ease: animation easing ease
spring: animation spring physics
stagger: animation stagger sequence
keyframe: animation keyframes timeline
keyframes: animation keyframes timeline
parallax: animation parallax scroll parallax
scrollytelling: animation scroll scrolltelling scrollytelling
marquee: animation marquee ticker loop
kenburns: animation kenburns zoompan
morph: animation morph shared-element
flip: animation flip transform
scroll: scroll animation
scrolling: scroll animation
smooth: scroll smooth locomotive lenis
hover: hover micro-interaction
ripple: ripple micro-interaction
toggle: toggle micro-interaction switch
frosted: glass frosted blur
blur: blur backdrop-filter glass
glassmorphism: glass frosted backdrop-filter
premium: premium luxury high-end polish
luxury: premium luxury high-end
expensive: premium high-end
elegant: elegant refined polish
refined: elegant refined polish
minimal: minimal restrained clean
restrained: minimal restrained
slop: anti-slop distinctive craft
generic: anti-slop distinctive
bland: anti-slop distinctive
jank: jank lag performance fps
janky: jank lag performance fps
laggy: lag performance
lag: lag performance
stutter: jank performance fps stuttering
stuttering: jank performance fps stuttering
choppy: jank performance fps
smoothness: performance fps 60fps
flicker: flicker performance paint
flickering: flicker performance paint
60fps: 60fps performance
framerate: fps performance 60fps
dropframe: fps performance jank
reduced: reduced-motion accessibility
accessibility: accessibility a11y
a11y: accessibility a11y
wcag: accessibility wcag a11y
3d: 3d webgl three
webgl: 3d webgl three
threejs: 3d three webgl"""
