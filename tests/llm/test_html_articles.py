"""What is the article's where pages mark it loosely."""

from flowmill.llm import html_extract

LONG = "A sentence of the article, long enough to count, with marks; and more of it follows here."


def test_ratios_decide_inside_containers():
    links = "".join(f'<li><a href="/{i}">Another story {i}</a></li>' for i in range(6))
    page = (f"<body><main><div><ul>{links}</ul></div><div class='x'><a href='/a'>More stories</a></div>"
            f"<div><h1><a href='/self'>Title</a></h1><p>{LONG}</p><ul><li>Item</li></ul><section><h2>Part</h2><p>{LONG}</p>"
            f"</section><p>See <a href='/b'>this</a>.</p></div></main></body>")
    assert html_extract.content(page) == ["Title", LONG, "Item", "Part", LONG, "See this."]


def test_each_container_is_read():
    page = (f"<body><div class='a'><article><h1>One</h1><p>{LONG}</p></article></div>"
            f"<div class='b'><article><h1>Two</h1><p>{LONG}</p></article></div><p>Text outside.</p></body>")
    assert html_extract.content(page) == ["One", LONG, "Two", LONG]
    assert html_extract.content("<article><p><a href='/'>All of it is a link</a></p></article>") == ["All of it is a link"]


def test_one_word_of_a_class_does_not_drop_the_article():
    article = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = ["Title", LONG, LONG]
    for around in ("<div class='layout has-sidebar'><article>{}</article></div>", "<div class='no-sidebar'><article>{}</article></div>",
                   "<article class='post no-comments'>{}</article>", "<div class='wrap sidebar'><div>{}</div></div>",
                   "<article>{}<div class='comments'><p>Nice post, thanks!</p></div><span class='ad'>Buy!</span></article>",
                   "<div class='sidebar'><p>Side text, with marks.</p></div><article>{}</article>",
                   "<div class='ad'><p>" + 9 * LONG + "</p></div><article>{}</article>",
                   "<div class='sidebar'><p>" + 9 * LONG + "</p></div><article>{}</article>",
                   "<article>{}<div class='ad'><p>" + 9 * LONG + "</p></div></article>",
                   "<article>{}<div hidden><p>Unseen.</p></div></article>"):
        assert html_extract.content(around.format(article)) == want, around
    inner = (f"<article><div class='entry-header'><h2 id='discussion'>Discussion</h2><p>{LONG}</p></div>"
             f"<section id='related'><h2 class='notice'>Related work</h2><p>{LONG}</p></section>"
             f"<section id='related-work'><p>{LONG}</p></section><p class='side'>{LONG}</p><p class='ad'>Buy, now!</p></article>")
    assert html_extract.content(inner) == ["Discussion", LONG, "Related work", LONG, LONG, LONG]


def test_replies_notices_and_adverts_by_joined_names():
    article = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = ["Title", LONG, LONG]
    reply = "<p>Nice post, thanks, I liked it a lot; more of it, please.</p>" * 9
    for around in ("<section id='comments'>{}</section>", "<div class='comments-area'>{}</div>", "<ol class='comment-list'><li>{}</li></ol>",
                   "<div class='comment-body'>{}</div>", "<div class='comments-section'>{}</div>", "<div id='post-comments'>{}</div>",
                   "<section class='post-comments'><article>{}</article><article>{}</article></section>"):
        around = around.replace("{}", reply)
        for page in (f"<body><article>{article}{around}</article></body>", f"<body><div>{article}</div>{around}</body>",
                     f"<body><article>{article}</article>{around}</body>"):
            assert html_extract.content(page) == want, page
    short = "<p>Some words here, to be seen; all around.</p>"
    for name in ("cookie-banner", "related-posts", "newsletter-signup", "site-footer", "ad-container", "main-nav", "share_buttons"):
        for page in (f"<body><article>{article}<div class='{name}'>{short}</div></article></body>",
                     f"<body><div>{article}</div><div class='{name}'>{short}</div></body>"):
            assert html_extract.content(page) == want, page
    for name in ("has-sidebar", "no-comments", "related-work", "with-ad", "discussion-section", "entry-header", "post-content", "head-to-head"):
        assert html_extract.content(f"<article>{article}<div class='{name}'>{short}</div></article>") == [
            *want, "Some words here, to be seen; all around."], name


def test_forms_and_controls():
    article = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = ["Title", LONG, LONG]
    login = "<form><p>Log in, please</p><label>Name</label><input><button>Go</button></form>"
    for page in (f"<body><form><div>{article}</div></form></body>", f"<body><form><article>{article}</article></form>{login}</body>",
                 f"<body><article>{article}{login}</article></body>", f"<article>{article}<div><button>Subscribe</button></div></article>"):
        assert html_extract.content(page) == want, page
    assert html_extract.content(f"<article><p>{LONG}</p><p>Press the <button>Save</button> key, then <label>tick <b>this</b></label>.</p></article>"
                                ) == [LONG, "Press the Save key, then tick this."]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html_extract.extract(pages).count() == 0
