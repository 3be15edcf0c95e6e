"""Word lists, patterns and lookup tables that results must agree on."""

# Substrings of URLs that are no pages.
DEFAULT_EXCLUDES = ("/wp-admin/", "/wp-login", "/wp-json/", "/jkit-", "/elementor-", "elementor_library=", "?elementor", "/author/", "/category/", "/tag/", "/feed/", "/feed", "/cart/", "/checkout/", "/my-account/", "?p=")

# Social platforms and their domains; the first that matches counts.
SOCIAL = (
    ("facebook", "facebook.com"), ("instagram", "instagram.com"), ("twitter", "twitter.com"), ("x", "x.com"), ("linkedin", "linkedin.com"), ("youtube", "youtube.com"), ("tiktok", "tiktok.com"), ("pinterest", "pinterest.com"),
    ("snapchat", "snapchat.com"), ("github", "github.com"), ("vimeo", "vimeo.com"), ("threads", "threads.net"), ("bluesky", "bsky.app"), ("mastodon", "mastodon.social"), ("medium", "medium.com"), ("dribbble", "dribbble.com"), ("behance", "behance.net"),
)
SHARE_MARKS = ("/sharing/share", "/sharer/", "/intent/tweet", "/intent/post", "?text=", "&text=", "/share?", "share-article", "/dialog/share")
UTILITY_LABELS = ("login", "log in", "sign in", "sign up", "pricing", "search", "cart", "checkout", "account")

# Patterns of addresses, numbers, colours and styles.
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
PHONE = r"\+?\d[\d ().\-]{7,}\d"
HEX = r"#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"
RGB = r"(?i)rgba?\([0-9]+(?:\.[0-9]+)?(?:\s*,\s*[0-9]+(?:\.[0-9]+)?){2,3}\s*\)"
HSL = r"(?i)hsla?\([0-9]+(?:\.[0-9]+)?(?:\s*,?\s*[0-9]+(?:\.[0-9]+)?%?){2,3}\s*\)"
FONT = r"""(?i)font-family\s*:\s*([^;}\n"]+|"[^"]+"|'[^']+')"""
CSS_VARIABLE = r"--([a-zA-Z][a-zA-Z0-9_\-]*)\s*:\s*([^;}\n]+?)\s*[;}]"
DATE_PREFIX = r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}"

# Country codes in the order they are tried.
COUNTRY_CODES = ("420", "421", "1", "44", "49", "33", "39", "34", "31", "32", "351", "353", "354", "358", "45", "46", "47", "48", "30", "36", "40", "43", "41", "352", "356", "357", "359", "370", "371", "372", "385", "386", "387")

# Page categories after home, with the needles of each.
CATEGORIES = (
    ("contact", ("/contact", "/kontakt", "kontakt", "contact")),
    ("about", ("/about", "/o-nas", "/o-spolocnosti", "/about-us", "/team")),
    ("legal", ("/privacy", "/cookies", "/gdpr", "/terms", "/obchodni-podminky", "/zasady", "/legal", "/imprint")),
    ("blog-index", ("/news", "/aktuality")),
    ("product", ("/products/", "/product/", "/shop/", "/store/", "/collections/", "/produkty/")),
    ("service", ("/service", "/sluzby", "/produkt")),
    ("pricing", ("/pricing", "/cenik", "/cenika")),
    ("case-study", ("/case-stud", "/pripadova", "/reference")),
)
LEGAL_PATHS = ("/privacy", "/terms", "/legal", "/impressum", "/imprint", "/ccpa", "/gdpr", "/cookies", "/obchodni-podminky", "/zasady")

# Hosts of embeds.
EMBEDS = (
    ("youtube", ("youtube.com", "youtu.be", "youtube-nocookie.com")), ("vimeo", ("vimeo.com",)), ("maps", ("google.com/maps", "maps.google.")), ("spotify", ("spotify.com",)), ("soundcloud", ("soundcloud.com",)), ("twitter", ("twitter.com", "x.com")),
    ("instagram", ("instagram.com",)), ("facebook", ("facebook.com",)), ("typeform", ("typeform.com",)), ("calendly", ("calendly.com",)), ("hubspot", ("hubspot",)),
)
PARKED_HOSTS = ("rapidresultsearch.com", "sedoparking.com", "afternic.com", "bodis.com", "parkingcrew.net", "dan.com", "godaddy.com/forsale")
POOR_ALTS = ("image", "photo", "picture", "logo", "icon", "img", "title", "alt", "untitled", "thumbnail", "banner")
CURRENCIES = ("$", "€", "£", "¥", "kč", "eur", "usd", "czk", "pln", "/mo", "/month", "/year")
CODE_LANGUAGES = ("rust", "javascript", "typescript", "python", "go", "java", "kotlin", "swift", "ruby", "php", "csharp", "cpp", "c", "html", "css", "json", "yaml", "toml", "bash", "shell", "sh", "sql", "markdown", "md", "xml")
TRACKERS = ("googletagmanager", "google-analytics", "facebook.com/tr", "doubleclick", "analytics", "tracking", "pixel", "beacon")
CHALLENGES = ("just a moment...", "verifying you are human", "cf-browser-verification", "cf-challenge-running", "challenge-platform", "checking your browser before accessing", "attention required! | cloudflare", "ddos protection by cloudflare", "/_px/", "perimeterx")

# Styles of code themes and of style libraries; three hits of one drop all its colours.
THEMES = (
    ("#e06c75", "#98c379", "#d19a66", "#61afef", "#c678dd", "#56b6c2", "#abb2bf", "#282c34"),
    ("#ff79c6", "#bd93f9", "#50fa7b", "#ffb86c", "#8be9fd", "#f1fa8c", "#ff5555", "#282a36"),
    ("#f92672", "#a6e22e", "#fd971f", "#66d9ef", "#ae81ff", "#e6db74", "#272822", "#75715e"),
    ("#cc6666", "#b5bd68", "#f0c674", "#81a2be", "#b294bb", "#8abeb7", "#c5c8c6", "#1d1f21"),
    ("#268bd2", "#dc322f", "#859900", "#b58900", "#6c71c4", "#d33682", "#2aa198", "#cb4b16"),
    ("#bf616a", "#a3be8c", "#ebcb8b", "#81a1c1", "#b48ead", "#88c0d0", "#d08770", "#5e81ac"),
    ("#f38ba8", "#a6e3a1", "#f9e2af", "#89b4fa", "#cba6f7", "#94e2d5", "#fab387", "#eba0ac"),
    ("#d9534f", "#5cb85c", "#f0ad4e", "#5bc0de", "#428bca", "#337ab7", "#3071a9", "#46b8da"),
    ("#dc3545", "#28a745", "#ffc107", "#17a2b8", "#007bff", "#6c757d", "#343a40", "#f8f9fa"),
)
PLAIN_COLOURS = ("#fff", "#ffffff", "#000", "#000000", "#0000", "#00000000")
CODE_SELECTORS = (".hljs", ".token", "prism", ".highlight", "pre code", ".code-", "[data-language", ".chroma", ".rouge", ".codehilite")
GENERIC_FONTS = ("inherit", "initial", "unset", "sans-serif", "serif", "monospace", "cursive", "fantasy", "system-ui", "ui-sans-serif", "ui-serif", "ui-monospace", "ui-rounded", "emoji", "math", "fangsong")
ICON_FONTS = ("etmodules", "swiper-icons", "slick-icons", "ionicons", "feather", "octicons", "pagebuilder-font", "solid-icons", "wp-icons", "slick", "swiper", "splide", "flickity", "owl", "owl carousel", "owl-carousel", "icons", "icon", "icomoon", "iconmoon", "icofont", "themify", "lineicons", "dripicons", "linearicons", "eicons", "elementskit", "essential-addons", "ekiticons", "uicons")
FONT_WEIGHTS = ("hairline", "ultralight", "extralight", "thin", "light", "book", "regular", "normal", "medium", "demibold", "semibold", "bold", "extrabold", "ultrabold", "heavy", "black", "italic", "oblique")
WEBFONTS = (("google", ("fonts.googleapis.com",)), ("adobe", ("use.typekit.net", "typekit.com")), ("bunny", ("fonts.bunny.net",)), ("cdnfonts", ("fonts.cdnfonts.com",)))

# Technologies with their confidence, evidence and needles in lower-case text; each inner tuple needs one hit, and all inner tuples must hit.
FRAMEWORKS = (
    ("Next.js", "high", "__NEXT_DATA__ or /_next/static asset path", (("__next_data__", "/_next/static/"),)),
    ("Astro", "high", "astro-island / data-astro", (("data-astro", "astro-island"),)),
    ("Hugo", "high", "meta generator=Hugo", (('name="generator" content="hugo',),)),
    ("Gatsby", "high", "meta generator=Gatsby", (('name="generator" content="gatsby',),)),
    ("Shopify", "high", "Shopify CDN / monorail / namespace", (("cdn.shopify.com", "shopify-section", "shopify.shop", "//cdn.shop/", "shopifycdn.com", "monorail-edge.shopifysvc.com", 'name="shopify-'),)),
    ("Webflow", "high", "data-wf-page / webflow.io", (("webflow.io", "data-wf-page"),)),
    ("Squarespace", "high", "static1.squarespace.com asset", (("squarespace.com",),)),
    ("Remix", "high", "__remix_run_ / Remix context global", (("__remix_run_", "window.__remixcontext"),)),
    ("SvelteKit", "high", "data-sveltekit-* attribute", (("data-sveltekit", "window.__sveltekit"),)),
    ("Solid.js", "high", "_$HY hydration global", (("window._$hy", "_$hy="),)),
    ("Qwik", "high", "q:container attribute", (("q:container", "q:script"),)),
    ("React", "medium", "data-react / react-dom signature", (("data-react", "react-dom", "__reactrootcontainer"),)),
    ("Nuxt / Vue", "high", "__nuxt / data-v-app", (("data-v-app", "__nuxt"),)),
    ("SvelteKit", "high", "/_app/immutable/ asset path", (("/_app/immutable/",),)),
    ("Tailwind CSS", "medium", "heavy utility-class usage (flex / text-* / bg-*)", (('class="flex ',), ("text-",), ("bg-",))),
    ("Phoenix LiveView", "high", "phx-* attribute signature", (("phx-track-static", "phx-mounted", "phx-window", "data-phx-"),)),
    ("Ruby on Rails", "medium", "data-turbo-* / csrf-token + Rails marker", (("turbo-cable-stream-source", "data-turbo-"),)),
    ("Django", "high", "csrfmiddlewaretoken hidden input", (("csrfmiddlewaretoken",),)),
    ("Laravel", "medium", "_token + csrf-token meta signature", (('name="_token"',), ("laravel_session", 'name="csrf-token"'))),
    ("Jekyll", "high", "meta generator=Jekyll", (('name="generator" content="jekyll',),)),
    ("Eleventy", "high", "meta generator=Eleventy", (('name="generator" content="eleventy', 'name="generator" content="11ty'),)),
)
VITE = r"/assets/[a-zA-Z][a-zA-Z0-9_-]*-[A-Za-z0-9_-]{6,10}\.(?:js|css)"
