"""Pages as a headless browser shows them, if one is installed on the executors."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame

from .fetch import Client, asked

#: Fixed values. After loading, a page is scrolled so many times at most, with a pause (milliseconds) after each.
SCROLLS, PAUSE = 8, 400


def rendered_pages(urls: DataFrame, user_agent: str, timeout: float = 20.0, wait_ms: int = 2000, spacing: float = 1.0, clock: DataFrame | None = None) -> DataFrame:
    """(url, html, asked) of (url, and `allowed` as robots.judge() tells it), scrolled to the end and settled; html is null where a page cannot be shown or there is no browser. A task starts one browser, with its first page, and closes it."""

    def client() -> Client:
        c = Client(user_agent, timeout, 1, spacing)
        c.browser = Browser(user_agent, timeout, wait_ms)
        return c

    return asked(urls, "url string, html string, asked double", client, lambda c, url: (c.browser.html(url),), clock)


class Browser:
    """A headless browser that is started with its first page and closed with the worker."""

    def __init__(self, user_agent: str, timeout: float, wait_ms: int):
        self.user_agent, self.timeout, self.wait_ms = user_agent, timeout, wait_ms
        self.browser = None

    def open(self) -> bool:
        if self.browser is None:
            try:
                from playwright.sync_api import sync_playwright
            except ImportError:
                return False
            tools = sync_playwright().start()
            self.browser = tools.chromium.launch()
            atexit.register(tools.stop)
            atexit.register(self.browser.close)
        return True

    def html(self, url: str) -> str | None:
        if not self.open():
            return None
        from playwright.sync_api import Error

        page = self.browser.new_page(user_agent=self.user_agent)
        try:
            page.goto(url, timeout=1000 * self.timeout, wait_until="networkidle")
            settle(page, self.wait_ms)
            return page.content()
        except Error:
            return None
        finally:
            page.close()


def settle(page, wait_ms: int) -> None:
    """Wheels down until the page no longer grows, so that what loads on sight is there, then waits."""
    height = -1
    for _ in range(SCROLLS):
        now = page.evaluate("document.body.scrollHeight")
        if now == height:
            break
        height = now
        page.mouse.wheel(0, now)
        page.wait_for_timeout(PAUSE)
    page.wait_for_timeout(wait_ms)
