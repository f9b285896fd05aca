"""Catalogues: tools by name, editor operations, and adapters by document schema."""

from __future__ import annotations

from collections.abc import Callable

from .operators import closure, connections, cycles, filegraph, fold, graph, integrity, knowledge, resolve
from .sources import code, descriptors, editor, files, ini, sinks

TOOLS: dict[str, Callable] = {
    "find-projects": files.find_projects,
    "find-build-descriptor": files.find_build_descriptor,
    "read-project-descriptor": descriptors.plugin_references,
    "resolve-engine": files.resolve_engine,
    "inspect-modules": resolve.reconcile,
    "inspect-targets": closure.inherited,
    "list-project-sources": files.iter_files,
    "list-module-sources": resolve.pairing,
    "resolve-plugins": filegraph.resolve_plugins,
    "classify-paths": filegraph.classify_paths,
    "read-plugin-descriptor": descriptors.modules,
    "inspect-module-rules": code.rule_dependencies,
    "inspect-target-rules": filegraph.rules_classes,
    "inspect-cs-function": filegraph.receiver_types,
    "inspect-module-entry": filegraph.module_entries,
    "list-includes": resolve.include_candidates,
    "list-types": filegraph.interface_candidates,
    "inspect-cxx-function": resolve.declaration_relation,
    "analyze-dependencies": filegraph.type_graph,
    "dependency-document": graph.document,
    "trace-function-flow": filegraph.function_flow,
    "query-hierarchy": closure.descendants,
    "analyze-impact": closure.impact,
    "find-cycles": cycles.cycles,
    "scan-config-graph": ini.parse,
    "fold-config": fold.fold_declarations,
    "build-graph": knowledge.build,
    "validate-graph": integrity.validate_graph,
    "diff-graph": integrity.diff_nodes,
    "build-file-graph": filegraph.build,
    "write-file-graph": sinks.write_snapshot,
    "browse-graph": closure.neighbourhood,
    "resolve-connection": connections.connection_status,
}
EDITOR: dict[str, Callable] = {
    "asset_inventory": editor.inventory,
    "asset_dependencies": editor.dependencies,
    "data_tables": editor.data_table_rows,
    "blueprint_list": editor.blueprints,
    "blueprint_inspect": editor.inspect_graph,
    "blueprint_structure": editor.structure,
    "gameplay_tags": editor.tags,
    "tag_referencers": editor.tag_referencers,
    "message_nodes": editor.message_nodes,
    "primary_assets": editor.primary_assets,
    "editor_state": editor.editor_state,
    "data_assets": resolve.property_delta,
    "select_session": editor.select_session,
}


def list_tools() -> list[str]:
    return sorted(TOOLS)


def dispatch(name: str, *args, **kwargs):
    """Run an editor operation by name; unknown names are errors."""
    if name not in EDITOR:
        raise ValueError(f"unknown operation {name}")
    return EDITOR[name](*args, **kwargs)
