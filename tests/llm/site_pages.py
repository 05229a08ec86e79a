"""Pages in the manner of common site software, written apart from the training pages, with the text that belongs to the article.

Each template is a page as such software writes it: its own elements, class names, order and boilerplate, in plain English.
"""

import html
import random

WORDS = (
    "river bridge council winter market garden school engine music bread history island north visitor summer glass yellow early quiet local"
    " national several people worked began opened carried found built crossed returned during after before beside without because although"
    " three hundred new old small large first last young public private road harbour museum train morning evening report study measure change"
).split()


class Site:
    def __init__(self, seed):
        self.r = random.Random(f"site {seed}")
        self.want = []

    def sentence(self, low=6, high=22):
        w = [self.r.choice(WORDS) for _ in range(self.r.randint(low, high))]
        if len(w) > 9 and self.r.random() < 0.5:
            w[4] += ","
        return " ".join(w).capitalize() + self.r.choice("...?")

    def prose(self):
        return " ".join(self.sentence() for _ in range(self.r.randint(2, 6)))

    def title(self):
        return " ".join(self.r.choice(WORDS) for _ in range(self.r.randint(4, 9))).capitalize()

    def keep(self, text):
        """Text of the article: noted as wanted, escaped for the page."""
        self.want.append(text)
        return html.escape(text, quote=False)

    def name(self):
        return self.r.choice(["Anna", "Tom", "Priya", "Jonas", "Lee"]) + " " + self.r.choice(["Moss", "Berg", "Stone", "Park"])

    def links(self, n, sep="", wrap="<li>{}</li>"):
        return sep.join(wrap.format(f'<a href="/{k}">{self.r.choice(WORDS).capitalize()} {self.r.choice(WORDS)}</a>') for k in range(n))

    def body(self, tag="p"):
        out = []
        for k in range(self.r.randint(3, 9)):
            if k and self.r.random() < 0.2:
                out.append(f"<h2>{self.keep(self.title())}</h2>")
            if self.r.random() < 0.1:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.sentence(3, 9))}</li>" for _ in range(3)) + "</ul>")
            out.append(f"<{tag}>{self.keep(self.prose())}</{tag}>\n")
        return "".join(out)

    # templates

    def press(self):
        comments = "".join(f'<li class="comment even" id="comment-{k}"><article class="comment-body"><footer class="comment-meta"><b class="fn">{self.name()}</b> <span class="says">says:</span> <time>March {k + 1}, 2021 at 9:12 am</time></footer><div class="comment-content"><p>{self.prose()}</p></div><div class="reply"><a href="#r">Reply</a></div></article></li>' for k in range(self.r.randint(0, 4)))
        return f"""<!DOCTYPE html><html lang="en-GB"><head><meta charset="utf-8"><title>t</title><script>document.write("<p>no</p></head>");</script></head>
<body class="single post-template-default"><a class="skip-link" href="#c">Skip to content</a><header id="masthead" class="site-header"><p class="site-title"><a href="/">The {self.title()}</a></p><nav class="main-navigation"><ul>{self.links(6)}</ul></nav></header>
<main id="primary"><article class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">{self.keep(self.title())}</h1></header><div class="entry-content">{self.body()}<div class="sharedaddy"><h3>Share this:</h3><ul>{self.links(3)}</ul></div></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">Thoughts on this post</h2><ol class="comment-list">{comments}</ol><form class="comment-form"><label>Comment</label><textarea>x</textarea><p>Your email address will not be published.</p><input type=submit></form></div></main>
<aside class="widget-area"><section class="widget widget_recent_entries"><h2>Recent Posts</h2><ul>{self.links(5)}</ul></section></aside><footer class="site-footer"><p>Proudly powered by something</p><p>&copy; 2021 {self.name()}</p></footer></body></html>"""

    def paper(self):
        return f"""<html><head><style>div > p {{ color: red }}</style></head><body><div class="cmp-banner" role="dialog"><p>We and our 812 partners store and access information on your device.</p><button>Agree</button><button>Reject all</button></div>
<div id="topnav">{self.links(7, " | ", "{}")}</div><div class="page"><div class="story"><h1>{self.keep(self.title())}</h1><div class="ad-unit"><span>Advertisement</span></div><div class="story-body">{self.body()}</div><div class="related-box"><h4>More on this story</h4>{self.links(4, "", "<p>{}</p>")}</div></div>
<div class="right-rail"><h3>Most read</h3><ol>{self.links(5)}</ol><div class="newsletter-signup"><p>Get the best of our journalism in your inbox each morning.</p><form><input name=e><button>Sign up</button></form></div></div></div><div class="footer-links">{self.links(6, " ", "{}")}<p>All rights reserved. {self.name()} Media Ltd.</p></div></body></html>"""

    def soup(self):
        return f"""<!doctype html><html><body><div class="x1"><div class="x2">{self.links(6, "", "<div>{}</div>")}</div></div>
<div class="q"><div class="q7"><div class="k">{self.keep(self.title())}</div>{self.body("div")}</div><div class="z z3"><div>{self.links(1, "", "{}")}</div><div>{self.links(1, "", "{}")}</div><div>{self.links(1, "", "{}")}</div></div></div><div class="v"><div>Terms of service</div><div>Privacy policy</div><div>&copy; 2019 {self.name()}</div></div></body></html>"""

    def old(self):
        return f"""<HTML><BODY BGCOLOR=#ffffff><TABLE WIDTH=100% BORDER=0><TR><TD COLSPAN=2><FONT SIZE=5>{self.name()}'s page</FONT></TD></TR><TR><TD WIDTH=140 VALIGN=top>{self.links(8, "<BR>", "{}")}</TD>
<TD VALIGN=top><H1>{self.keep(self.title())}</H1>{self.body("P")}</TD></TR><TR><TD COLSPAN=2 ALIGN=center><FONT SIZE=1>Copyright 1999 {self.name()}. <A HREF="mailto:x">Mail me</A></FONT></TD></TR></TABLE></BODY></HTML>"""

    def plain(self):
        return f"<body><p>{self.links(5, ' - ', '{}')}</p><h1>{self.keep(self.title())}</h1>{self.body()}<hr><p><small>&copy; {self.name()} 2004</small></p></body>"

    def docs(self):
        return f"""<!DOCTYPE html><html><body><nav class="toc sidebar"><ul>{self.links(9)}</ul></nav><div role="main" class="document"><section id="s"><h1>{self.keep(self.title())}</h1>{self.body()}<pre>{self.keep("make install")}</pre><p>{self.keep(self.prose())}</p></section></div><div class="pager"><a href=a>Previous</a> <a href=b>Next page</a></div><footer role="contentinfo">&#169; Copyright 2022, {self.name()}.</footer></body></html>"""

    def forum(self):
        replies = "".join(f"<div class='cmt'><div class='u'>{self.name()} &middot; {k + 2} hours ago</div><div>{self.sentence()}</div><a href=#>Reply</a></div>" for k in range(self.r.randint(1, 5)))
        return f"""<html><body><div class=hdr><a href=/>Home</a> <a href=/l>Log in</a></div><article><h1>{self.keep(self.title())}</h1>{self.body()}</article><h3>{self.r.randint(1, 30)} Comments</h3><div class="responses">{replies}</div><div class=ft>Back to top</div></body></html>"""


TEMPLATES = ("press", "paper", "soup", "old", "plain", "docs", "forum")


def site_page(template, seed):
    """(html, text of the article)."""
    s = Site(f"{template} {seed}")
    page = getattr(s, template)()
    return page, "\n".join(s.want)
