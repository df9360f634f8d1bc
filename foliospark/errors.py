"""Errors of the engine. Problems of a row become columns; these end a query."""


class FolioError(Exception):
    """Any error of the engine."""


class ContentError(FolioError):
    """A content list, report or checkpoint that isn't what it should be."""


class TaskNotFound(FolioError):
    """No task of that id."""


class InvalidTaskState(FolioError):
    """A transition that the task's state doesn't allow."""
