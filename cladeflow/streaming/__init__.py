"""Incremental operators on streams of trees and events."""
